"""Record stores through the data source: round trips, segments left out by filters, commits of jobs that fail, fan-in."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cairn.sources import stores as S

ROWS = [(f"k{i:03d}", i, None if i % 7 == 0 else f"täxt\n{i}") for i in range(90)]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "key string, n long, text string").repartition(3)


def test_round_trip_and_modes(spark, frame, path):
    S.write(frame, path)
    assert sorted(map(tuple, S.read(spark, path).collect())) == ROWS and S.read(spark, path).schema.names == ["key", "n", "text"]
    S.write(frame.limit(0), path)
    S.write(spark.createDataFrame([("z", 1, "more"), (None, 2, "no key")], frame.schema), path)
    assert S.read(spark, path).count() == 92 and S.read(spark, path).where("key is null").count() == 1
    S.write(frame.where("n < 5"), path, mode="overwrite")
    assert S.read(spark, path).count() == 5 and S.Backend(path).manifest()["number"] == 4
    with pytest.raises(Exception, match="no store"):
        S.read(spark, path + "x").collect()


def test_filters_leave_segments_out(spark, frame, path):
    for lo in range(0, 90, 30):
        S.write(frame.where((F.col("n") >= lo) & (F.col("n") < lo + 30)).coalesce(1), path)
    every = len(S.Backend(path).manifest()["segments"])
    for where, n in (("key = 'k031'", 1), ("key in ('k001', 'k089')", 2), ("key >= 'k080'", 10), ("key < 'k002' and n > 0", 1), ("n = 5", 1), ("key = 'none'", 0)):
        df = S.read(spark, path).where(where)
        assert df.count() == n
        if "key = " in where:
            assert S.read(spark, path).where(where).select("n").rdd.getNumPartitions() < every


def test_a_job_that_fails_commits_nothing(spark, frame, path):
    S.write(frame.where("n < 10"), path)
    bad = frame.withColumn("n", F.when(F.col("n") == 50, F.raise_error(F.lit("stop"))).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        S.write(bad, path)
    assert S.read(spark, path).count() == 10 and S.Backend(path).manifest()["number"] == 1


def test_segments_are_lines_of_json(frame, path):
    S.write(frame.coalesce(1), path)
    backend = S.Backend(path)
    got = [r for s in backend.manifest()["segments"] for r in backend.read(s["name"])]
    assert sorted(r["n"] for r in got) == list(range(90)) and json.dumps(got[0])
    assert issubclass(PythonException, Exception)
