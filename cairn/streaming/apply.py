"""The feed applied as a stream: one stateful operator keeps, by what an event reaches, the last write, the last deletion and the sequence numbers seen.

An event is dealt to the keys that it touches: a put and a deletion of one key to that key, a deletion of an actor's keys to the actor, one of everything (or of all keys
saved by themselves) to a key of its own, and every event to a bucket of SPAN sequence numbers of its origin. So no state grows with the feed, no wide deletion is copied to the keys that it
hides, and no origin is one task. Orders only rise and a bucket only fills, so rows may come late, in any order and more than once: the state is that of a batch over all of them.

An event-time timer closes a bucket once the watermark is `wait` past its last event: what is still missing is told once more as final, and the bucket forgets its bits.
What the operator writes are updates; `standing` and `sequences` read them as tables, the last row of each key.

Needs the RocksDB state store, which `run` sets for the query it starts and sets back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.sources.staging import fresh_path

SPAN = 512
_LONG, _TEXT = ST.LongType(), ST.StringType()


def _struct(**fields: ST.DataType) -> ST.StructType:
    return ST.StructType([ST.StructField(k, t) for k, t in fields.items()])


#: written out, as workers of a stream have no session to read DDL with
ORDER = _struct(ts_ms=_LONG, origin=_TEXT, sequence=_LONG, id=_LONG)
PUT = _struct(ts_ms=_LONG, origin=_TEXT, sequence=_LONG, id=_LONG, actor=_TEXT)
BITS = _struct(bits=ST.BinaryType(), low=_LONG, high=_LONG, closes=_LONG)
UPDATES = _struct(reach=_TEXT, part=_TEXT, put=ORDER, actor=_TEXT, gone=ORDER, seen=ST.IntegerType(), low=_LONG, high=_LONG, missing=ST.ArrayType(ST.IntegerType()), final=ST.BooleanType())
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def touched(events: DataFrame, step: int = 1) -> DataFrame:
    """(reach, part, kind, actor_id, o, index, at) for each key that an event of (id, kind, key, actor_id, origin, sequence, ts_ms, at) touches. step: the distance of an origin's numbers."""
    o = F.struct("ts_ms", "origin", "sequence", "id")
    index = F.floor(F.col("sequence") / step).cast("long")
    to = lambda reach, part: F.struct(F.lit(reach).alias("reach"), part.alias("part"))
    memory = F.when(F.col("kind").isin("put", "delete"), to("key", F.col("key"))).when(F.col("kind") == "delete_scoped", to("actor", F.col("actor_id"))).when(F.col("kind").isin("delete_all", "delete_autosaved"), to("all", F.col("kind")))
    bucket = to("origin", F.concat_ws("|", "origin", F.floor(index / SPAN).cast("string")))
    each = events.select("kind", "actor_id", o.alias("o"), index.alias("index"), "at", F.explode(F.filter(F.array(memory, bucket), lambda x: x.isNotNull())).alias("x"))
    return each.select("x.reach", "x.part", "kind", "actor_id", "o", "index", "at")


def _row(order: tuple | None) -> dict | None:
    return dict(zip(ORDER.names, order[:4], strict=True)) if order else None


class Apply(StatefulProcessor):
    """State of one key: its last put and deletion, or the numbers seen of its bucket."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._put, self._gone, self._bits = (handle.getValueState(name, kind) for name, kind in (("put", PUT), ("gone", ORDER), ("bits", BITS)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        reach, part = key
        if reach == "origin":
            yield from self._numbers(part, rows, timerValues)
            return
        put, gone = self._put.get() if self._put.exists() else None, self._gone.get() if self._gone.exists() else None
        put, gone = tuple(put) if put else None, tuple(gone) if gone else None
        was = put, gone
        for r in rows:
            o = tuple(r["o"][c] for c in ORDER.names)
            if r["kind"] == "put":
                put = max(put, (*o, r["actor_id"]), key=lambda x: x[:4]) if put else (*o, r["actor_id"])
            else:
                gone = max(gone, o) if gone else o
        if (put, gone) != was:
            if put:
                self._put.update(put)
            if gone:
                self._gone.update(gone)
            yield Row(reach=reach, part=part, put=_row(put), actor=put[4] if put else None, gone=_row(gone), seen=None, low=None, high=None, missing=None, final=None)

    def _numbers(self, part: str, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._bits.get() if self._bits.exists() else None
        bits = int.from_bytes(held[0], "little") if held else 0
        low, high, closes = (held[1], held[2], held[3]) if held else (None, None, None)
        before, last = bits, 0
        for r in rows:
            bits |= 1 << r["index"] % SPAN
            low = r["index"] if low is None else min(low, r["index"])
            high = r["index"] if high is None else max(high, r["index"])
            last = max(last, r["o"]["ts_ms"])
        if bits == before:
            return
        if closes is None or last + self.wait_ms > closes:
            if closes is not None:
                self._handle.deleteTimer(closes)
            closes = max(last + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self._handle.registerTimer(closes)
        self._bits.update((bits.to_bytes(SPAN // 8, "little"), low, high, closes))
        yield self._told(part, bits, low, high, False)

    def _told(self, part: str, bits: int, low: int, high: int, final: bool) -> Row:
        base = low - low % SPAN
        missing = [i - base for i in range(low, high + 1) if not bits >> i % SPAN & 1]
        return Row(reach="origin", part=part, put=None, actor=None, gone=None, seen=bits.bit_count(), low=low, high=high, missing=missing, final=final)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._bits.get() if self._bits.exists() else None
        if held:
            yield self._told(key[1], int.from_bytes(held[0], "little"), held[1], held[2], True)
            self._bits.clear()

    def close(self) -> None:
        pass


def applied(events: DataFrame, late: str = "30 days", wait_ms: int = 30 * 86_400_000, step: int = 1) -> DataFrame:
    """Updates of each key (UPDATES) of a stream of events with a time `at`."""
    keyed = touched(events.withWatermark("at", late), step)
    return keyed.groupBy("reach", "part").transformWithState(statefulProcessor=Apply(wait_ms), outputStructType=UPDATES, outputMode="Update", timeMode="EventTime")


def run(spark: SparkSession, updates: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs over what is there, from where the checkpoint ends, and returns all updates so far. A batch that is written again takes its first folder's place."""
    out, checkpoint = out or fresh_path(spark, "updates"), checkpoint or fresh_path(spark, "updates-checkpoint")
    setting = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(setting)
    spark.conf.set(setting, PROVIDER)
    try:
        write = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")
        updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, was)
    return spark.read.schema(ST.StructType([*UPDATES, ST.StructField("n", ST.IntegerType())])).parquet(f"{out}/batch=*")


def standing(updates: DataFrame) -> DataFrame:
    """(key, id): the last put of each key that no deletion of its key, its actor, of everything, or of keys saved by themselves hides."""
    keys = updates.where("reach = 'key'").groupBy(F.col("part").alias("key")).agg(F.max(F.struct("put", "actor")).alias("p"), F.max("gone").alias("gone"))
    actors = updates.where("reach = 'actor'").groupBy(F.col("part").alias("actor")).agg(F.max("gone").alias("scoped"))
    wide = updates.where("reach = 'all'").agg(F.max(F.when(F.col("part") == "delete_all", F.col("gone"))).alias("everything"), F.max(F.when(F.col("part") == "delete_autosaved", F.col("gone"))).alias("autosaved"))
    both = keys.where("p.put is not null").select("key", "p.put", "p.actor", "gone").join(actors, "actor", "left").join(F.broadcast(wide))  # one row
    hides = F.greatest("gone", "scoped", "everything", F.when(F.col("key").startswith("autosave_"), F.col("autosaved")))
    return both.where(hides.isNull() | (F.col("put") > hides)).select("key", F.col("put.id").alias("id"))


def sequences(updates: DataFrame) -> DataFrame:
    """(origin, bucket, seen, low, high, missing): numbers of each bucket that came, their bounds, and those between that did not. Of a bucket that was closed and opened anew the fuller row stands."""
    o = updates.where("reach = 'origin'")
    last = o.groupBy("part").agg(F.max_by(F.struct("seen", "low", "high", "missing"), F.struct("seen", "n")).alias("x"))
    return last.select(F.substring_index("part", "|", 1).alias("origin"), F.substring_index("part", "|", -1).cast("long").alias("bucket"), "x.*")
