"""What vector scans hold on the driver."""

import numpy as np

from cairn.operators import vector_index as I
from cairn.plans import batch
from tests.test_index import DIMS, answers, brute, frame
from tests.test_oracles import DATA


def test_the_driver_holds_one_scan(spark, monkeypatch):
    """No block of queries is sent before the one before it is taken back, and none is larger than the bound."""
    v = np.random.default_rng(8).normal(size=(1200, DIMS))
    table, sent, most = frame(spark, v), [], []
    monkeypatch.setattr(I, "PASS_BYTES", 16 * DIMS * 8)
    scan = I._scan

    def counted(spark, index, block, limit, within):
        found, shared = scan(spark, index, block, limit, within)
        sent.append(block.num_rows)
        take = shared.destroy
        shared.destroy = lambda *a: (sent.pop(), take(*a))
        most.append(sum(sent))
        return found, shared

    monkeypatch.setattr(I, "_scan", counted)
    got = answers(I.nearest(I.build(table, DIMS), table.where("id % 20 = 0"), 3))
    assert got == {q: ids for q, (ids, _) in brute(v, 3, bar=2.0).items()}
    assert len(most) > 3 and max(most) <= 16 and not sent


def shuffled(met):
    plan = met._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin [band" in plan and "BroadcastHashJoin [band" not in plan


def test_probes_are_not_broadcast(spark):
    """Thousands of probes stand for one query, so their join with the buckets is shuffled, however small Spark takes them for."""
    v = np.random.default_rng(9).normal(size=(400, DIMS))
    index = I.build(frame(spark, v), DIMS)
    met = I.candidates(index, index.classes.where("cls % 20 = 0"), dense=1.0)
    met.collect()
    assert shuffled(met)


def test_search_batch_broadcasts_no_probes(spark, monkeypatch):
    made, find = [], I.candidates
    monkeypatch.setattr(I, "candidates", lambda *a: made.append(find(*a)) or made[-1])
    assert batch.search_batch(spark, DATA).count() > 0
    assert len(made) == 1 and shuffled(made[0])
