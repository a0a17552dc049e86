"""The event feed as a stream: deduplication within a watermark, last-writer-wins state, windowed counts, and incremental export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.formats import append_missing
from cairn.sources.staging import fresh_path
from cairn.sources.tables import feed_rows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events of a folder or glob of Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def feed(spark: SparkSession, path: str) -> DataFrame:
    return feed_rows(events(spark, path)).withColumn("at", F.timestamp_millis("ts_ms"))


def deduplicated(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """The first event of each dedupe key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["dedupe_key"])


def counts(stream: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Events by type in tumbling windows (an addition: the feed itself has no windows)."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def last_writers(stream: DataFrame) -> DataFrame:
    """Per key the write that is last by (time, origin, sequence, id), whatever order writes arrive in; in update mode a row for each change. The state is
    one row a key, kept and combined in the JVM; it ends with the key space, which deletions do not shrink."""
    writes = stream.where("event_type like 'agent_memory.%'")
    last = F.max_by(F.struct("id", "event_type", "ts_ms"), F.struct("ts_ms", "origin", "sequence", "id"))
    return writes.groupBy("object_id").agg(last.alias("x")).select("object_id", "x.id", "x.event_type", "x.ts_ms")


def run_once(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote."""
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def export(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("id",)) -> None:
    """Append what the table at path has not got, batch by batch, from where the checkpoint ends; replays write nothing twice."""
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_missing(spark, df, path, keys) and None).trigger(availableNow=True).start().awaitTermination()
