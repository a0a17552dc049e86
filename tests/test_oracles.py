"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import glob
import math
import os

import duckdb
import pytest

from cairn.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    found = rows(got.columns, got.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert found or name in ("lsh_candidates",)
        return
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert found == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
