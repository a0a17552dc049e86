"""External record stores as a Spark data source: format("record_store") reads a store's segments in parallel and writes to it with a commit.

A store is a folder: segments of JSON lines, and numbered manifests that name them with the least and the greatest key of each. Reading makes one partition a segment, and leaves out those
that filters on the key (equal, one of, a range) cannot meet; other filters stay with Spark. Writing makes a segment a task, under a name of its own, and one manifest at the end: a
failed or repeated task leaves no segment in use, and a failed job none at all. Another kind of store plugs in by another `Backend`.

Options: path (any file system that Arrow knows), key (the column, "key" if none is given), and for writing mode append or overwrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "record_store"


class Backend:
    """Segments and manifests of one store in a folder."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def manifest(self) -> dict:
        """The newest manifest; an empty one if there is none."""
        found = [f.path for f in self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if f.base_name.startswith("manifest-")]
        if not found:
            return {"number": 0, "schema": None, "segments": []}
        with self.store.open_input_stream(max(found)) as f:
            return json.loads(f.read())

    def commit(self, manifest: dict) -> None:
        name, draft = f"{self.root}/manifest-{manifest['number']:010d}", f"{self.root}/_draft-{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as f:
            f.write(json.dumps(manifest).encode())
        self.store.move(draft, name)

    def write(self, lines: list[str]) -> str:
        self.store.create_dir(self.root, recursive=True)
        name = f"segment-{uuid.uuid4().hex}.jsonl"
        with self.store.open_output_stream(f"{self.root}/{name}") as f:
            for line in lines:
                f.write((line + "\n").encode())
        return name

    def read(self, segment: str) -> Iterator[dict]:
        with self.store.open_input_stream(f"{self.root}/{segment}") as f:
            left = b""
            while block := f.read(1 << 20):
                *whole, left = (left + block).split(b"\n")
                yield from map(json.loads, whole)

    def remove(self, segment: str) -> None:
        self.store.delete_file(f"{self.root}/{segment}")


@dataclass
class Segment(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    n: int
    low: object
    high: object


class StoreReader(DataSourceReader):
    def __init__(self, path: str, key: str, schema: StructType):
        self.path, self.key, self.schema = path, key, schema
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the key choose segments; all stay with Spark too, as a segment holds other keys."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,) and hasattr(f, "value"):
                v = f.value
                if isinstance(f, EqualTo):
                    self.tests.append(lambda a, z, v=v: a <= v <= z)
                elif isinstance(f, In):
                    self.tests.append(lambda a, z, v=v: any(a <= x <= z for x in v if x is not None))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.tests.append(lambda a, z, v=v: z >= v)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.tests.append(lambda a, z, v=v: a <= v)
            yield f

    def partitions(self) -> list[Segment]:
        segments = Backend(self.path).manifest()["segments"]
        return [Segment(s["name"]) for s in segments if all(s["low"] is not None and t(s["low"], s["high"]) for t in self.tests)]

    def read(self, partition: Segment | None) -> Iterator[tuple]:
        if partition is None:  # no segment is left to read
            return
        for r in Backend(self.path).read(partition.name):
            yield tuple(r.get(c) for c in self.schema.names)


class StoreWriter(DataSourceWriter):
    def __init__(self, path: str, key: str, schema: StructType, overwrite: bool):
        self.path, self.key, self.schema, self.overwrite = path, key, schema, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        lines, keys = [], []
        for r in iterator:
            lines.append(json.dumps(r.asDict(True), ensure_ascii=False))
            keys.append(r[self.key])
        known = [k for k in keys if k is not None]
        return Written(Backend(self.path).write(lines) if lines else None, len(lines), min(known, default=None), max(known, default=None))

    def commit(self, messages: list[Written | None]) -> None:
        backend = Backend(self.path)
        before = backend.manifest()
        new = [{"name": m.name, "n": m.n, "low": m.low, "high": m.high} for m in messages if m and m.name]
        backend.store.create_dir(backend.root, recursive=True)
        backend.commit({"number": before["number"] + 1, "schema": self.schema.json(), "segments": new if self.overwrite else before["segments"] + new})

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.name:
                Backend(self.path).remove(m.name)


class RecordStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        said = Backend(self.options["path"]).manifest()["schema"]
        if said is None:
            raise ValueError(f"no store at {self.options['path']}")
        return StructType.fromJson(json.loads(said))

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(self.options["path"], self.options.get("key", "key"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], self.options.get("key", "key"), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.dataSource.register(RecordStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("key", key).load(path)


def write(df: DataFrame, path: str, key: str = "key", mode: str = "append") -> None:
    """Rows ranged by key, so that segments hold ranges of keys."""
    register(df.sparkSession)
    df.repartitionByRange(key).sortWithinPartitions(key).write.format(FORMAT).option("key", key).mode(mode).save(path)
