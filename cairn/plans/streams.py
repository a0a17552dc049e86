"""Streams of the feed, run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.feed import _WRITES
from cairn.sources.tables import sql
from cairn.streaming import apply as AP
from cairn.streaming import feed_stream as FS

Q, O = {}, {}


def _path(d: str) -> str:
    return f"{d}/events.parque[t]"  # a glob, so that a single file is a source too


def stream_dedupe(spark, d):
    got = FS.run_once(spark, FS.deduplicated(FS.feed(spark, _path(d)), "3650 days"), "dedupe")
    return got.select("dedupe_key").groupBy("dedupe_key").agg(F.count("*").alias("n"))


O["stream_dedupe"] = sql("feed", "select dedupe_key, 1 as n from feed group by 1")


def stream_last_writers(spark, d):
    got = FS.run_once(spark, FS.last_writers(FS.feed(spark, _path(d))), "writers", "update")
    return got.groupBy("object_id").agg(F.max_by("id", F.struct("ts_ms", "id")).alias("id"))


O["stream_last_writers"] = sql("feed", "select object_id, id from feed where starts_with(event_type, 'agent_memory.') qualify row_number() over (partition by object_id order by ts_ms desc, origin desc, sequence desc, id desc) = 1")


def stream_counts(spark, d):
    got = FS.run_once(spark, FS.counts(FS.feed(spark, _path(d))), "counts", "complete")
    return got.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("windows"))


O["stream_counts"] = sql("feed", "select event_type, count(*) as n, count(distinct ts_ms // 86400000) as windows from feed group by 1")

def _events(spark, d):
    """The feed with the kind of each memory write, as tombstones tells it; other events count for their origin's numbers alone."""
    f = FS.feed(spark, _path(d))
    kind = F.when(F.col("event_type") == "agent_memory.put", "put").when(F.col("event_type") == "agent_memory.delete", F.when(F.col("id") % 97 == 3, "delete_all").when(F.col("id") % 31 == 3, "delete_scoped").when(F.col("id") % 37 == 3, "delete_autosaved").otherwise("delete"))
    key = F.when(F.col("id") % 4 == 0, F.concat(F.lit("autosave_"), "object_id")).otherwise(F.col("object_id"))
    return f.select("id", kind.alias("kind"), key.alias("key"), "actor_id", "origin", "sequence", "ts_ms", "at")


def _applied(spark, d):
    return AP.run(spark, AP.applied(_events(spark, d), "3650 days", step=3))


def stream_apply(spark, d):
    """The last put of each key that stands, from the states of a stream."""
    return AP.standing(_applied(spark, d))


O["stream_apply"] = sql("feed", "").rstrip() + f", {_WRITES}, l as (select * from w where kind = 'put' qualify row_number() over (partition by key order by o desc) = 1) select key, id from l p where not exists (select 1 from w x where x.o >= p.o and (x.kind = 'delete_all' or x.kind = 'delete' and x.key = p.key or x.kind = 'delete_scoped' and x.actor_id = p.actor_id or x.kind = 'delete_autosaved' and starts_with(p.key, 'autosave_')))"


def stream_sequences(spark, d):
    """Numbers seen and missing by origin and bucket, from the states of a stream."""
    s = AP.sequences(_applied(spark, d))
    return s.select("origin", "bucket", F.col("seen").cast("long").alias("seen"), "low", "high", F.size("missing").cast("long").alias("missing"), F.element_at(F.col("missing"), 1).cast("long").alias("first_missing"))


O["stream_sequences"] = sql("feed", f"select origin, b as bucket, len(s) as seen, low, high, len(m) as missing, m[1] - b * {AP.SPAN} as first_missing from (select *, list_filter(generate_series(low, high), lambda i: not list_contains(s, i)) as m from (select origin, b, list(distinct i) as s, min(i) as low, max(i) as high from (select origin, sequence // 3 as i, sequence // 3 // {AP.SPAN} as b from feed) group by 1, 2))")

Q |= {"stream_apply": stream_apply, "stream_sequences": stream_sequences}
Q |= {"stream_dedupe": stream_dedupe, "stream_last_writers": stream_last_writers, "stream_counts": stream_counts}
