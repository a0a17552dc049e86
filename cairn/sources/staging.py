"""Tables and streams written to the cluster's shared folder: lineage ends there, and lost executors cost nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-ckpt-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(known.get()).rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are removed at its end: for a result that is written inside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the scope around it, or of the session."""
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}/{name}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return path


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_INDEXES: dict[tuple, object] = {}


def kept_index(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], object]) -> object:
    """What build writes, once in a session for the same input files: their names, lengths and times of change tell them. A changed input is built anew."""
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = []
    for top in inputs:
        path = path_of(top)
        listed = path.getFileSystem(conf).listFiles(path, True)
        while listed.hasNext():
            f = listed.next()
            files.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(sorted(files)))
    if key not in _INDEXES:
        _SCOPES.append([])  # an index outlives the scope in which it is first asked for
        try:
            _INDEXES[key] = build()
        finally:
            for path in _SCOPES.pop():
                atexit.register(_remove, spark, path)
    return _INDEXES[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hdfs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hdfs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hdfs.getParent(), True)
    except Exception:  # the session is gone at exit: nothing left to clean with
        return
