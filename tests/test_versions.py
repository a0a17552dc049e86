"""The versioned log: states as of ids, versions that readers hold, crashes before the manifest, writers that meet."""

import random

import pytest

from cairn.sources import versions as W

COLUMNS = "object_id string, ts_ms long, origin string, sequence long, id long, value string"


def made(n):
    r = random.Random(5)
    return [(f"k{r.randrange(12)}", r.randrange(60), f"o{r.randrange(3)}", r.randrange(9), i, f"v{i}") for i in range(1, n + 1)]


def state(rows, at):
    out = {}
    for x in rows:
        if x[4] <= at:
            old = out.get(x[0])
            out[x[0]] = max(old, x, key=lambda y: y[1:5]) if old else x
    return set(out.values())


def told(df):
    return set(map(tuple, df.collect()))


@pytest.fixture
def log(spark, tmp_path):
    return W.VersionedLog(spark, f"file://{tmp_path}/log", W.last_writers)


def test_states_as_of_ids(spark, log):
    rows = made(300)
    frame = lambda a, z: spark.createDataFrame(rows[a:z], COLUMNS)
    assert log.version() == W.Version(0, ()) and log.state() is None and log.compact().number == 0
    log.append(frame(0, 100))
    log.append(frame(100, 200))
    log.compact()
    log.append(frame(200, 300))
    assert log.numbers() == [1, 2, 3, 4] and log.version().upto == 300 and log.version().folded == 200
    for at in (1, 99, 100, 150, 200, 250, 300, 999):  # before the snapshot from older versions, after it from the newest
        assert told(log.state(at)) == state(rows, at), at
    assert told(log.state()) == state(rows, 300) and told(log.state(number=3)) == state(rows, 200)
    assert log.state(0) is None or not log.state(0).count()


def test_a_reader_keeps_its_version(spark, log):
    rows = made(120)
    log.append(spark.createDataFrame(rows[:60], COLUMNS))
    held = log.version()
    log.append(spark.createDataFrame(rows[60:], COLUMNS))
    log.compact()
    reader = log.state(number=held.number)
    assert len(log.vacuum(keep=[held.number])) == 1  # the second tail: neither the newest version nor the held one names it
    assert told(reader) == state(rows, 60) and told(log.state()) == state(rows, 120) and log.numbers() == [1, 3]
    assert len(log.vacuum()) == 1 and log.numbers() == [3] and told(log.state()) == state(rows, 120)
    with pytest.raises(ValueError):
        log.state(30)  # folded away, and no version is left that tells it


def test_a_crash_before_the_manifest_changes_nothing(spark, log, monkeypatch):
    rows = made(80)
    log.append(spark.createDataFrame(rows[:50], COLUMNS))

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(log, "_commit", crash)
        for work in (lambda: log.append(spark.createDataFrame(rows[50:], COLUMNS)), log.compact):
            with pytest.raises(KeyboardInterrupt):
                work()
    assert log.numbers() == [1] and told(log.state()) == state(rows, 50)
    log.append(spark.createDataFrame(rows[50:], COLUMNS))  # written again as if nothing had been
    assert told(log.state()) == state(rows, 80) and len(log.vacuum(keep=log.numbers())) == 2


def test_writers_that_meet(spark, log):
    rows = made(60)
    base = log.append(spark.createDataFrame(rows[:20], COLUMNS))
    log.append(spark.createDataFrame(rows[20:40], COLUMNS), base)
    with pytest.raises(W.VersionConflict):
        log.append(spark.createDataFrame(rows[40:], COLUMNS), base)
    assert told(log.state()) == state(rows, 40)
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame(rows[30:], COLUMNS))  # ids that are there already
    log.append(spark.createDataFrame(rows[40:], COLUMNS))
    assert told(log.state()) == state(rows, 60) and log.append(spark.createDataFrame([], COLUMNS)).number == log.version().number
