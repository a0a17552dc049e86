"""A log kept in versions: data folders written by Spark, and small manifests that name them. A folder that no manifest names does not exist for readers.

path/data/<random>      events ("tail", with the ids from and upto that they span) or a state ("snapshot", as of an id)
path/manifest/<number>  JSON, one a version: the folders of that version, in order

A writer writes its folder first and then the next manifest, which is created and never replaced: of two writers that read the same version one fails and writes again from the
new one, and a crash in between leaves a folder that nobody reads. Compaction writes the state as of its last id and a version that begins with it; older versions stay
readable, with all their folders, until `vacuum` is told which versions are in use. A state as of an id is read from the newest version that has not folded that id away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]


class VersionConflict(Exception):
    """Another writer made the version that this one meant to make."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[dict, ...]

    @property
    def upto(self) -> int:
        """The last id that the version knows, -1 if none; ids are not negative."""
        return max((p["upto"] for p in self.parts), default=-1)

    @property
    def folded(self) -> int:
        """Ids up to this are in a snapshot, and no state before it can be told from this version."""
        return max((p["upto"] for p in self.parts if p["kind"] == "snapshot"), default=-1)


class VersionedLog:
    """fold: rows (events, or a state and events after it, with `id`) to the state, in the same columns; folding a state again with what follows gives the state of all."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._conf, self._of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _fs(self, path: str):
        p = self._of(path)
        return p.getFileSystem(self._conf), p

    def numbers(self) -> list[int]:
        """Versions that there are, rising."""
        fs, p = self._fs(f"{self.path}/manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def version(self, number: int | None = None) -> Version:
        """A version by its number, the newest if none is given; version 0 is empty."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return Version(0, ())
        text = self.spark.read.text(f"{self.path}/manifest/{number:010d}", wholetext=True).first()["value"]
        return Version(number, tuple(json.loads(text)["parts"]))

    def _commit(self, base: Version, parts: Iterable[dict]) -> Version:
        new = Version(base.number + 1, tuple(parts))
        fs, target = self._fs(f"{self.path}/manifest/{new.number:010d}")
        _, draft = self._fs(f"{self.path}/manifest/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"parts": new.parts}).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(draft, target):  # whole or not at all
            fs.delete(draft, False)
            raise VersionConflict(f"version {new.number} is there")
        return new

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, events: DataFrame, base: Version | None = None) -> Version:
        """The version with these events behind it. Their ids are above those of the version."""
        base = base or self.version()
        folder = self._write(events)
        span = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.min("id").alias("a"), F.max("id").alias("z")).first()
        if span["a"] is None:
            return base
        if span["a"] <= base.upto:
            raise ValueError(f"ids up to {base.upto} are there")
        return self._commit(base, (*base.parts, {"kind": "tail", "folder": folder, "from": span["a"], "upto": span["z"]}))

    def compact(self, base: Version | None = None) -> Version:
        """The version whose only part is the state as of its last id."""
        base = base or self.version()
        if not base.parts:
            return base
        folder = self._write(self.fold(self._rows(base.parts)))
        return self._commit(base, ({"kind": "snapshot", "folder": folder, "from": 0, "upto": base.upto},))

    def _rows(self, parts: Iterable[dict]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/{p['folder']}") for p in parts))

    def state(self, at: int | None = None, number: int | None = None) -> DataFrame | None:
        """The state as of an id (the newest if none), from the version given or the newest that can tell it; None if nothing is known by then."""
        known = [self.version(number)] if number is not None else (self.version(n) for n in reversed(self.numbers()))
        for v in known:
            if at is None or v.folded <= at:
                parts = [p for p in v.parts if at is None or p["from"] <= at]
                if not parts:
                    return None
                rows = self._rows(parts)
                return self.fold(rows if at is None else rows.where(F.col("id") <= at))
        if not self.numbers():
            return None
        raise ValueError(f"no version that is left tells the state as of {at}")

    def vacuum(self, keep: Iterable[int] = ()) -> list[str]:
        """Removes all versions but the newest and those in use, and the folders that none of these names, half-written ones too; returns the folders removed. No writer may be at work."""
        numbers = self.numbers()
        stay = {*keep, *numbers[-1:]}
        named = {p["folder"] for n in numbers if n in stay for p in self.version(n).parts}
        for n in numbers:
            if n not in stay:
                fs, p = self._fs(f"{self.path}/manifest/{n:010d}")
                fs.delete(p, False)
        fs, data = self._fs(f"{self.path}/data")
        gone = [f"data/{s.getPath().getName()}" for s in fs.listStatus(data) if f"data/{s.getPath().getName()}" not in named] if fs.exists(data) else []
        for folder in gone:
            fs.delete(self._of(f"{self.path}/{folder}"), True)
        return sorted(gone)


def last_writers(rows: DataFrame) -> DataFrame:
    """The memory feed's state: of each key the write that is last by time, origin, sequence and id, in the columns of the rows."""
    order = F.struct("ts_ms", "origin", "sequence", "id")
    return rows.groupBy("object_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "object_id")), order).alias("x")).select("object_id", "x.*").select(*rows.columns)
