"""The feed applied as a stream: after shuffled and repeated input, late files and a restart the state is that of a batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn.streaming import apply as AP

COLUMNS = "id long, kind string, key string, actor_id string, origin string, sequence long, ts_ms long, at timestamp"
EPOCH = datetime(2024, 1, 1)
BASE = int((EPOCH - datetime(1970, 1, 1)).total_seconds() * 1000)


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["put"] * 12 + ["delete", "delete", "delete_scoped", "delete_autosaved", None, None]) if i != n // 3 else "delete_all"
        key = r.choice(["", "autosave_"]) + f"k{r.randrange(25)}"
        ms = r.randrange(40) * 1000  # many equal times: origin, number and id decide
        rows.append((i, kind, key, f"a{r.randrange(6)}", f"o{i % 3}", i // 3 * 2 if i % 11 else max(0, i // 3 * 2 - 8), BASE + ms, EPOCH + timedelta(milliseconds=ms)))
    return rows


def batch(rows):
    order = lambda x: (x[6], x[4], x[5], x[0])
    gone = {}
    puts = {}
    for x in rows:
        if x[1] == "put":
            puts[x[2]] = max(puts.get(x[2], x), x, key=order)
        elif x[1]:
            reach = {"delete": x[2], "delete_scoped": x[3]}.get(x[1], x[1])
            gone[x[1], reach] = max(gone.get((x[1], reach), ()), order(x))
    out = set()
    for key, x in puts.items():
        hides = [gone.get(("delete", key)), gone.get(("delete_scoped", x[3])), gone.get(("delete_all", "delete_all")), gone.get(("delete_autosaved", "delete_autosaved")) if key.startswith("autosave_") else None]
        if all(g is None or order(x) > g for g in hides):
            out.add((key, x[0]))
    return out


def numbers(rows):
    seen = {}
    for x in rows:
        seen.setdefault((x[4], x[5] // 2 // AP.SPAN), set()).add(x[5] // 2)
    return {(o, b, len(s), min(s), max(s), tuple(i - b * AP.SPAN for i in range(min(s), max(s) + 1) if i not in s)) for (o, b), s in seen.items()}


def put_file(spark, path, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, **more):
    events = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(path)
    return AP.applied(events, **{"late": "3650 days", "step": 2} | more)


def test_any_order_repeats_and_a_restart(spark, tmp_path):
    rows = made(3600, 1)
    r = random.Random(2)
    dealt = rows + r.sample(rows, 700)
    r.shuffle(dealt)
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(2):
        put_file(spark, path, dealt[k * 1500 : (k + 1) * 1500])
    first = AP.run(spark, stream(spark, path), out, checkpoint)
    so_far = dealt[:3000]
    assert {tuple(x) for x in AP.standing(first).collect()} == batch(so_far)
    put_file(spark, path, dealt[3000:] + rows[:50])
    last = AP.run(spark, stream(spark, path), out, checkpoint)  # a new query, from where the checkpoint ends
    assert last.select("n").distinct().count() == 3
    assert {tuple(x) for x in AP.standing(last).collect()} == batch(rows)
    assert {(*tuple(x)[:5], tuple(x["missing"])) for x in AP.sequences(last).collect()} == numbers(rows)
    assert AP.run(spark, stream(spark, path), out, checkpoint).count() == last.count()  # nothing new: nothing is told


def test_states_do_not_grow_with_the_feed(spark):
    """Each event touches its reach and one bucket; a deletion of everything is one row."""
    rows = made(600, 3)
    got = AP.touched(spark.createDataFrame(rows, COLUMNS), 2)
    reaches = {(x["reach"], x["part"]) for x in got.collect()}
    assert {p for k, p in reaches if k == "all"} <= {"delete_all", "delete_autosaved"} and {p for k, p in reaches if k == "actor"} <= {f"a{i}" for i in range(6)}
    assert len([p for k, p in reaches if k == "origin"]) == 3 and got.count() == sum(1 + (x[1] is not None) for x in rows)


def test_buckets_close_when_the_watermark_has_passed(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    day = 86_400_000
    event = lambda i, number, days: (i, None, "k", "a", "o0", number, BASE + days * day, EPOCH + timedelta(days=days))
    for rows in ([event(0, 0, 0), event(1, 2, 0), event(2, 6, 1)], [event(3, 2 * AP.SPAN, 30)], [event(4, 2 * AP.SPAN + 2, 31)]):
        put_file(spark, path, rows)
        told = AP.run(spark, stream(spark, path, late="1 day", wait_ms=2 * day), out, checkpoint)
    final = told.where("final").collect()
    assert [(x["part"], x["seen"], x["low"], x["high"], x["missing"]) for x in final] == [("o0|0", 3, 0, 3, [2])]
    assert {(x["bucket"], x["seen"], tuple(x["missing"])) for x in AP.sequences(told).collect()} == {(0, 3, (2,)), (1, 2, ())}


def test_nothing_is_left_set(spark):
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("n", [0, 1])
def test_small_streams(spark, tmp_path, n):
    path = str(tmp_path / "in")
    put_file(spark, path, made(3, 1)[:n])
    got = AP.run(spark, stream(spark, path), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert AP.standing(got).count() <= n and AP.sequences(got).count() == n and got.where(F.col("reach") == "origin").count() == n
