"""Tasks whose size does not follow the tables: graph_neighbors."""

import duckdb

from cairn.plans import graph
from tests.test_oracles import DATA, rows


def test_edges_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 100)
    got = graph.graph_neighbors(spark, DATA)
    assert got.rdd.getNumPartitions() > 60  # 6000 line items, each from both ends
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "lineitem"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.execute(graph.O["graph_neighbors"])
    names = [x[0] for x in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
