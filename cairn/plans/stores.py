"""Queries over stores of their own: the versioned log of the feed, and record stores read through the data source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.search import _MEM, memories
from cairn.sources import stores as ST
from cairn.sources import tables as S
from cairn.sources import versions as V
from cairn.sources.staging import fresh_path
from cairn.sources.tables import sql

Q, O = {}, {}


def _writes(spark, d) -> DataFrame:
    return S.feed(spark, d).where("event_type like 'agent_memory.%'").select("id", "object_id", "event_type", "ts_ms", "origin", "sequence")


def feed_versions(spark, d):
    """States as of a quarter, a half and the whole of the log, from versions: two tails, a snapshot of both, and a third tail behind it. The first state is from before the snapshot."""
    w = _writes(spark, d)
    last = w.agg(F.max("id").alias("id")).first()["id"]
    if last is None:
        return w.limit(0).select(F.col("id").alias("at"), "object_id", "event_type", "id")
    log = V.VersionedLog(spark, fresh_path(spark, "feed-log"), V.last_writers)
    log.append(w.where(F.col("id") <= last // 3))
    log.append(w.where((F.col("id") > last // 3) & (F.col("id") <= last // 2)))
    log.compact()
    log.append(w.where(F.col("id") > last // 2))
    states = ((at, log.state(at)) for at in (last // 4, last // 2, last))
    return reduce(DataFrame.unionByName, (s.select(F.lit(at).cast("long").alias("at"), "object_id", "event_type", "id") for at, s in states if s is not None))


O["feed_versions"] = sql("feed", "").rstrip() + ", w as (select * from feed where starts_with(event_type, 'agent_memory.')), a as (select unnest([m // 4, m // 2, m]) as at_ from (select max(id) as m from w)) select at_ as \"at\", object_id, arg_max(event_type, (ts_ms, origin, sequence, id)) as event_type, arg_max(id, (ts_ms, origin, sequence, id)) as id from w join a on id <= at_ group by 1, 2"

ROUTE = ("native", "lru")


def store_fan_in(spark, d):
    """One row for a key over two stores that are read through the data source: the first store in route order keeps it."""
    m = memories(spark, d).select("key", "store", "session_id")
    found = None
    for place, name in enumerate(ROUTE):
        path = fresh_path(spark, name)
        ST.write(m.where(F.col("store") == name), path)
        one = ST.read(spark, path).withColumn("place", F.lit(place))
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("key").orderBy("place", "session_id")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "store", "session_id")


O["store_fan_in"] = sql("messages", "").rstrip() + f", {_MEM} select key, store, session_id from mem qualify row_number() over (partition by key order by case when store = 'native' then 0 else 1 end, session_id) = 1"


def store_lookup(spark, d):
    """Records of a store by key: the filter reaches the reader, which opens the segments that may hold these keys alone."""
    m, path = memories(spark, d).select("key", "store", "session_id"), fresh_path(spark, "lookup")
    ST.write(m, path)
    return ST.read(spark, path).where(F.col("key").isin("note_1_0", "note_7_1", "note_39_2"))


O["store_lookup"] = sql("messages", "").rstrip() + f", {_MEM} select key, store, session_id from mem where key in ('note_1_0', 'note_7_1', 'note_39_2')"

for _f in (feed_versions, store_fan_in, store_lookup):
    Q[_f.__name__] = _f
