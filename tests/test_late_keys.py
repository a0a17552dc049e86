"""Queries over tables whose ids go on beyond the present moment (id 576,000) give the rows of their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from cairn.plans import registry
from tests.test_oracles import DATA, rows

FIRST = 576_000 - 100


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    d = tmp_path_factory.mktemp("late")
    for name, key in (("documents", "doc_id"), ("embeddings", "vec_id")):
        t = pq.read_table(f"{DATA}/{name}.parquet")
        moved = t.set_column(0, key, pc.add(t.column(key), FIRST))
        asked = [t.slice(0, 1)] if name == "embeddings" else []  # the vector that stands for the query keeps its id
        pq.write_table(pa.concat_tables([moved, *asked]), f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["temporal_decay", "search_pipeline", "search_batch"])
def test_times_to_come(spark, late, name):
    got = registry.queries()[name](spark, late)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{late}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    want = want.fetchall()
    assert rows(got.columns, got.collect()) == rows(names, want) and want
