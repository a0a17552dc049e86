"""Feed, analytics, sessions and lifecycle queries."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import access as A
from cairn.functions import lifecycle as L
from cairn.functions import texts as X
from cairn.plans.access import _SEEN, _VIS, ME
from cairn.sources import tables as S
from cairn.sources.staging import staged
from cairn.sources.tables import sql

Q, O = {}, {}
_NOW = "(select max(verified_at_ms) from atoms)"


def feed_since(spark, d):
    return S.feed(spark, d).where("id > 500").orderBy("id").limit(200).select("id", "event_type", "object_id")


O["feed_since"] = sql("feed", "select id, event_type, object_id from feed where id > 500 order by id limit 200")


def feed_dedupe(spark, d):
    """First event of each dedupe key, and whether a later one says something else."""
    f = S.feed(spark, d).withColumn("body", F.struct("event_type", "object_id", "actor_id"))
    g = f.groupBy("dedupe_key").agg(F.min(F.struct("id", "body")).alias("first"), F.count("*").alias("n"), F.min("body").alias("lo"), F.max("body").alias("hi"))
    return g.select("dedupe_key", F.col("first.id").alias("id"), "n", (F.col("lo") != F.col("hi")).alias("conflicting"))


O["feed_dedupe"] = sql("feed", "select dedupe_key, min(id) as id, count(*) as n, count(distinct event_type || '|' || object_id || '|' || actor_id) > 1 as conflicting from feed group by 1")


def agent_memory_state(spark, d):
    """Last writer of each key by time, origin and sequence."""
    f = S.feed(spark, d).where("event_type like 'agent_memory.%'")
    return f.groupBy("object_id").agg(F.max_by(F.struct("id", "event_type"), F.struct("ts_ms", "origin", "sequence", "id")).alias("x"), F.count("*").alias("writes")).select("object_id", "x.id", "x.event_type", "writes")


O["agent_memory_state"] = sql("feed", "select object_id, id, event_type, writes from (select *, count(*) over (partition by object_id) as writes, row_number() over (partition by object_id order by ts_ms desc, origin desc, sequence desc, id desc) as n from feed where starts_with(event_type, 'agent_memory.')) where n = 1")


def _writes(spark, d):
    """Memory writes and the four kinds of deletion: one key, all keys, all keys of the actor, keys that were saved by themselves."""
    kind = F.when(F.col("event_type") == "agent_memory.put", "put").when(F.col("event_type") == "agent_memory.delete", F.when(F.col("id") % 97 == 3, "delete_all").when(F.col("id") % 31 == 3, "delete_scoped").when(F.col("id") % 37 == 3, "delete_autosaved").otherwise("delete"))
    key = F.when(F.col("id") % 4 == 0, F.concat(F.lit("autosave_"), "object_id")).otherwise(F.col("object_id"))
    return S.feed(spark, d).select("id", "actor_id", key.alias("key"), kind.alias("kind"), F.struct("ts_ms", "origin", "sequence", "id").alias("o")).where("kind is not null")


def tombstones(spark, d):
    """Writes that no later deletion hides: of their key, of everything, of their actor, or of keys saved by themselves.
    The last deletion of each reach is one row a key, an actor, or in all."""
    w = _writes(spark, d)
    last = lambda kind, *by: w.where(F.col("kind") == kind).groupBy(*by).agg(F.max("o").alias(kind))
    wide = w.agg(F.max(F.when(F.col("kind") == "delete_all", F.col("o"))).alias("delete_all"), F.max(F.when(F.col("kind") == "delete_autosaved", F.col("o"))).alias("delete_autosaved"))
    puts = w.where("kind = 'put'").join(last("delete", "key"), "key", "left").join(last("delete_scoped", "actor_id"), "actor_id", "left").join(F.broadcast(wide))  # one row
    auto = F.when(F.col("key").startswith("autosave_"), F.col("delete_autosaved"))
    gone = F.greatest(F.col("delete"), F.col("delete_scoped"), F.col("delete_all"), auto)
    return puts.where(gone.isNull() | (F.col("o") > gone)).select("id", "key")


_WRITES = "w as (select id, actor_id, case when id % 4 = 0 then 'autosave_' || object_id else object_id end as key, case when event_type = 'agent_memory.put' then 'put' when id % 97 = 3 then 'delete_all' when id % 31 = 3 then 'delete_scoped' when id % 37 = 3 then 'delete_autosaved' else 'delete' end as kind, (ts_ms, origin, sequence, id) as o from feed where event_type in ('agent_memory.put', 'agent_memory.delete'))"
O["tombstones"] = sql("feed", "").rstrip() + f", {_WRITES} select id, key from w p where kind = 'put' and not exists (select 1 from w x where x.o >= p.o and (x.kind = 'delete_all' or x.kind = 'delete' and x.key = p.key or x.kind = 'delete_scoped' and x.actor_id = p.actor_id or x.kind = 'delete_autosaved' and starts_with(p.key, 'autosave_')))"


def feed_operations(spark, d):
    return S.feed(spark, d).groupBy(L.operation_of(F.col("event_type")).alias("operation")).agg(F.count("*").alias("n"))


_OP = "case event_type when 'agent_memory.put' then 'put' when 'source.created' then 'put' when 'agent_memory.merge_object' then 'merge_object' when 'agent_memory.merge_string_set' then 'merge_string_set' when 'agent_memory.delete' then 'delete' when 'memory_atom.verified' then 'verify' else 'supersede' end"
O["feed_operations"] = sql("feed", f"select {_OP} as operation, count(*) as n from feed group by 1")


def lifecycle_status(spark, d):
    return S.feed(spark, d).select("id", F.coalesce(L.status_after(L.operation_of(F.col("event_type"))), F.lit("active")).alias("status"))


O["lifecycle_status"] = sql("feed", "select id, case event_type when 'agent_memory.delete' then 'deprecated' when 'memory_atom.verified' then 'verified' when 'artifact.superseded' then 'superseded' else 'active' end as status from feed")


def feed_frontier(spark, d):
    return S.feed(spark, d).groupBy("origin").agg(F.max("sequence").alias("frontier"))


O["feed_frontier"] = sql("feed", "select origin, max(sequence) as frontier from feed group by 1")


def feed_compact(spark, d):
    """What stays above the floor: the last applied event of the first half of the log."""
    f = S.feed(spark, d)
    half = f.agg(F.floor(F.max("id") / 2).alias("half"))
    floor = f.join(F.broadcast(half), (f["status"] == "applied") & (f["id"] <= half["half"])).agg(F.max("id").alias("floor"))  # one row each
    return f.join(F.broadcast(floor), f["id"] > floor["floor"]).select("id", "status")


O["feed_compact"] = sql("feed", "select id, status from feed where id > (select max(id) from feed where status = 'applied' and id <= (select max(id) // 2 from feed))")


def feed_status(spark, d):
    f = S.feed(spark, d)
    seen = A.scope_visible(F.col("scope"), ME)
    return f.agg(F.count_if(seen).alias("visible"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "applying", "applied")), F.max("id").alias("max_id"), (F.max("sequence") + 1).alias("next_sequence"))


O["feed_status"] = sql("feed", f"select count(*) filter (where {_VIS}) as visible, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'applying') as applying, count(*) filter (where status = 'applied') as applied, max(id) as max_id, max(sequence) + 1 as next_sequence from feed")


def feed_redaction(spark, d):
    """Payloads that name a source which the actor may not see are replaced."""
    f = S.feed(spark, d).withColumn("payload", F.concat(F.lit('{"ref":"src_'), F.col("id") % 1000, F.lit('"}')))
    seen = S.sources(spark, d).where(A.record_visible(F.col("scope"), F.col("permissions"), ME)).select(F.col("id").alias("ref"), F.lit(True).alias("seen"))
    f = f.withColumn("ref", F.explode(F.regexp_extract_all("payload", F.lit("(src_[0-9]+)"), F.lit(1))))
    return f.join(seen, "ref", "left").groupBy("id").agg(F.min(F.coalesce("seen", F.lit(False))).alias("ok"), F.first("payload").alias("p")).select("id", F.when(F.col("ok"), F.col("p")).otherwise("{}").alias("payload"))


O["feed_redaction"] = sql("feed sources", f"select f.id, case when s.id is not null then '{{\"ref\":\"src_' || (f.id % 1000) || '\"}}' else '{{}}' end as payload from feed f left join (select id from sources where {_SEEN}) s on s.id = 'src_' || (f.id % 1000)")


def _leaves(patch: dict, path: tuple = ()):
    for k, v in patch.items():
        yield from _leaves(v, (*path, k)) if isinstance(v, dict) and v else [((*path, k), json.dumps(v))]


def _flat(batches):
    for b in batches:
        at, paths, values = [], [], []
        for i, (props, more) in enumerate(zip(b.column("props").to_pylist(), b.column("more").to_pylist(), strict=True)):
            for path, value in _leaves(json.loads(props or "{}") | json.loads(more)):
                at.append(i)
                paths.append(list(path))
                values.append(value)
        rows = b.select(["object_id", "o"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(paths, pa.list_(pa.string())), pa.array(values, pa.string())], names=["object_id", "o", "path", "value"])


def agent_memory_reduce(spark, d):
    """Objects merged in order of writing, the later value of a key winning, nested objects merged in turn.

    Patches are flattened to their leaves, and the last write of each leaf is a partial aggregate, so no object's history is gathered. A leaf falls to a later
    write of a value above it (which replaced the object it was in) or below it (an object that replaced the value).
    """
    f = S.feed(spark, d).where("event_type = 'agent_memory.merge_object'")
    more = F.to_json(F.struct(F.create_map(F.concat(F.lit("n"), (F.col("id") % 3).cast("string")), F.col("id")).alias("last")))
    flat = f.select("object_id", F.struct("ts_ms", "origin", "sequence", "id").alias("o"), "props", more.alias("more"))
    kind = flat.schema["o"].dataType.simpleString()
    last = staged(spark, flat.mapInArrow(_flat, f"object_id string, o {kind}, path array<string>, value string").groupBy("object_id", "path").agg(F.max_by("value", "o").alias("value"), F.max("o").alias("o")), "leaves")
    over = last.where("size(path) > 1").select("object_id", "o", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("head"))
    ends = last.select("object_id", F.col("path").alias("head"), F.col("o").alias("head_o"))
    met = over.join(ends, ["object_id", "head"])
    dead = met.where("head_o > o").select("object_id", "path").unionByName(met.where("head_o < o").select("object_id", F.col("head").alias("path"))).distinct()
    alive = last.join(dead, ["object_id", "path"], "left_anti")

    def built(leaves: pd.Series) -> pd.Series:
        def one(rows) -> str:
            out: dict = {}
            for r in rows:
                at = out
                for k in r["path"][:-1]:
                    at = at.setdefault(k, {})
                at[r["path"][-1]] = json.loads(r["value"])
            return json.dumps(out, sort_keys=True)

        return leaves.map(one)

    leaves = alive.groupBy("object_id").agg(F.collect_list(F.struct("path", "value")).alias("leaves"))  # one an attribute
    return leaves.select("object_id", F.pandas_udf(built, "string")("leaves").alias("state"))


_MERGES = "m as (select object_id, (ts_ms, origin, sequence, id) as o, id, props from feed where event_type = 'agent_memory.merge_object')"
O["agent_memory_reduce"] = sql("feed", "").rstrip() + f", {_MERGES}, l as (select object_id, 'n' || (id % 3) as k, arg_max(id, o) as v from m group by 1, 2), p as (select object_id, k, arg_max(json_extract(props, k)::varchar, o) as v from (select *, unnest(json_keys(props)) as k from m) group by 1, 2), t as (select object_id, k, v from p union all select object_id, 'last', '{{' || string_agg('\"' || k || '\": ' || v, ', ' order by k) || '}}' from l group by 1) select object_id, '{{' || string_agg('\"' || k || '\": ' || v, ', ' order by k) || '}}' as state from t group by 1"


def merge_object(spark, d):
    """Fields of the merged objects, counted."""
    return agent_memory_reduce(spark, d).select("object_id", F.size(F.json_object_keys("state")).cast("long").alias("fields"))


O["merge_object"] = sql("feed", "").rstrip() + f", {_MERGES} select object_id, count(distinct k) as fields from (select object_id, unnest(list_append(json_keys(props), 'last')) as k from m) group by 1"


def merge_string_set(spark, d):
    """Strings of a key in order of first writing; each string's first is found before they are gathered."""
    f = S.feed(spark, d).where("event_type = 'agent_memory.merge_string_set'").groupBy("object_id", F.concat(F.lit("t"), F.col("id") % 6).alias("s")).agg(F.min(F.struct("ts_ms", "id")).alias("o"))
    return f.groupBy("object_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), ",").alias("strings"))


O["merge_string_set"] = sql("feed", "select object_id, string_agg(s, ',' order by ts_ms, id) as strings from (select * from (select object_id, ts_ms, id, 't' || (id % 6) as s from feed where event_type = 'agent_memory.merge_string_set') qualify row_number() over (partition by object_id, s order by ts_ms, id) = 1) group by 1")


def _analytics(spark, d):
    """Two histories of one log with versions: audit from half of the events, feed from all."""
    f = S.feed(spark, d).select("id", "event_type", "object_id", "actor_id", "status", "ts_ms")
    return f.where("id % 2 = 0").withColumn("source", F.lit("audit")).unionByName(f.withColumn("source", F.lit("memory_feed")))


_AN = "an as (select 'audit' as source, id, event_type, object_id, actor_id, status, ts_ms from feed where id % 2 = 0 union all select 'memory_feed', id, event_type, object_id, actor_id, status, ts_ms from feed)"


def analytics_status(spark, d):
    last = lambda s: F.max(F.when(F.col("source") == s, F.col("id")))
    return _analytics(spark, d).agg(F.count("*").alias("events"), last("audit").alias("last_audit"), last("memory_feed").alias("last_feed"), F.max("ts_ms").alias("last_ms"))


O["analytics_status"] = sql("feed", "").rstrip() + f", {_AN} select count(*) as events, max(id) filter (where source = 'audit') as last_audit, max(id) filter (where source = 'memory_feed') as last_feed, max(ts_ms) as last_ms from an"


def analytics_final(spark, d):
    """The last version of each event."""
    a = _analytics(spark, d)
    twice = a.unionByName(a.where("id % 5 = 0").withColumn("ts_ms", F.col("ts_ms") + 1).withColumn("status", F.lit("revised")))
    return twice.groupBy("source", "id").agg(F.max_by("status", "ts_ms").alias("status"), F.max("ts_ms").alias("ts_ms"))


O["analytics_final"] = sql("feed", "").rstrip() + f", {_AN} select source, id, arg_max(status, ts_ms) as status, max(ts_ms) as ts_ms from (select source, id, status, ts_ms from an union all select source, id, 'revised', ts_ms + 1 from an where id % 5 = 0) group by 1, 2"


def analytics_query(spark, d, source: str | None = "audit", event_type: str | None = None, since: int = 100, limit: int = 100):
    """Events after an id that match the filters given, newest first."""
    a = _analytics(spark, d).where(F.col("id") > since)
    for name, value in (("source", source), ("event_type", event_type)):
        a = a.where(F.col(name) == value) if value else a
    return a.orderBy(F.desc("ts_ms"), "source", F.desc("id")).limit(limit).select("source", "id", "event_type", "ts_ms")


O["analytics_query"] = sql("feed", "").rstrip() + f", {_AN} select source, id, event_type, ts_ms from an where id > 100 and source = 'audit' order by ts_ms desc, source, id desc limit 100"


def analytics_export(spark, d):
    """Events that the store has not got yet."""
    a = _analytics(spark, d)
    have = a.where("id % 3 > 0").select("source", "id")
    return a.join(have, ["source", "id"], "left_anti").select("source", "id", "event_type")


O["analytics_export"] = sql("feed", "").rstrip() + f", {_AN} select source, id, event_type from an where id % 3 = 0"


def analytics_cursor(spark, d):
    return _analytics(spark, d).where("status = 'applied'").groupBy("source").agg(F.max("id").alias("cursor"))


O["analytics_cursor"] = sql("feed", "").rstrip() + f", {_AN} select source, max(id) as cursor from an where status = 'applied' group by 1"


def _leased(spark, d):
    """Work with a lease that ends some time after the event; the present is the latest event."""
    f = S.feed(spark, d)
    f = f.join(F.broadcast(f.agg(F.max("ts_ms").alias("now"))))  # one row
    late = (F.col("status") == "applying") & (F.col("ts_ms") + 3_600_000 * 24 * (F.col("id") % 5 + 1) < F.col("now"))
    return f.withColumn("state", F.when(late, "expired").otherwise(F.col("status")))


_LEASED = "q as (select *, case when status = 'applying' and ts_ms + 86400000 * (id % 5 + 1) < (select max(ts_ms) from feed) then 'expired' else status end as state from feed)"


def outbox_status(spark, d):
    """Counters of the outbox, and the next of each state."""
    return _leased(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.min("id").alias("next"))


O["outbox_status"] = sql("feed", "").rstrip() + f", {_LEASED} select state, count(*) as n, min(id) as next from q group by 1"


def outbox_claims(spark, d, batch: int = 250):
    """The next batch of work: pending, or claimed with an expired lease, in order."""
    return _leased(spark, d).where("state in ('pending', 'expired')").orderBy("id").limit(batch).select("id", "state", "object_id")


O["outbox_claims"] = sql("feed", "").rstrip() + f", {_LEASED} select id, state, object_id from q where state in ('pending', 'expired') order by id limit 250"


def job_claims(spark, d, batch: int = 25):
    """The next jobs of each kind, oldest first; running ones whose heartbeat is lost count as free."""
    w = Window.partitionBy("event_type").orderBy("ts_ms", "id")
    free = _leased(spark, d).where("state in ('pending', 'expired')")
    return free.withColumn("n", F.row_number().over(w)).where(F.col("n") <= batch).select("event_type", "id", F.col("n").cast("long").alias("n"))


O["job_claims"] = sql("feed", "").rstrip() + f", {_LEASED} select event_type, id, n from (select event_type, id, row_number() over (partition by event_type order by ts_ms, id) as n from q where state in ('pending', 'expired')) where n <= 25"


def job_counts(spark, d):
    return S.feed(spark, d).groupBy("event_type", "status").agg(F.count("*").alias("n"))


O["job_counts"] = sql("feed", "select event_type, status, count(*) as n from feed group by 1, 2")


def feed_restore(spark, d):
    """State of each key from a checkpoint of the first half of the log and the events after it; equal to that of the whole log."""
    f = S.feed(spark, d).where("event_type like 'agent_memory.%'").select("id", "object_id", "event_type", F.struct("ts_ms", "origin", "sequence", "id").alias("o"))
    half = f.agg(F.floor(F.max("id") / 2).alias("half"))
    f = f.join(F.broadcast(half))  # one row
    last = lambda df: df.groupBy("object_id").agg(F.max_by("event_type", "o").alias("event_type"), F.max("o").alias("o"))
    checkpoint = staged(spark, last(f.where("id <= half")), "checkpoint")
    return last(checkpoint.unionByName(f.where("id > half").select("object_id", "event_type", "o"))).select("object_id", "event_type", F.col("o.id").alias("id"))


O["feed_restore"] = sql("feed", "select object_id, arg_max(event_type, (ts_ms, origin, sequence, id)) as event_type, arg_max(id, (ts_ms, origin, sequence, id)) as id from feed where starts_with(event_type, 'agent_memory.') group by 1")


def _shown(spark, d):
    return S.messages(spark, d).where("role <> '__runtime_command__'")


def session_history(spark, d):
    """Sessions with the number, first and last of their messages, the latest first."""
    g = _shown(spark, d).groupBy("session_id").agg(F.count("*").alias("messages"), F.min("created_at_ms").alias("first_ms"), F.max("created_at_ms").alias("last_ms"))
    return g.orderBy(F.desc("last_ms"), "session_id").limit(50)


O["session_history"] = sql("messages", "select session_id, count(*) as messages, min(created_at_ms) as first_ms, max(created_at_ms) as last_ms from messages where role <> '__runtime_command__' group by 1 order by last_ms desc, session_id limit 50")


def session_merge(spark, d):
    """One row a session over two stores: most messages, first that is known, last."""
    g = _shown(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at_ms").alias("a"), F.max("created_at_ms").alias("z"))
    both = g.unionByName(g.select("session_id", (F.col("n") - 1).alias("n"), F.lit(0).cast("long").alias("a"), (F.col("z") + 5).alias("z")))
    return both.groupBy("session_id").agg(F.max("n").alias("messages"), F.min(F.nullif("a", F.lit(0))).alias("first_ms"), F.max("z").alias("last_ms"))


O["session_merge"] = sql("messages", "select session_id, count(*) as messages, min(created_at_ms) as first_ms, max(created_at_ms) + 5 as last_ms from messages where role <> '__runtime_command__' group by 1")


def session_messages(spark, d):
    """Messages of both stores once, in order."""
    m = _shown(spark, d).select("session_id", "created_at_ms", "role", F.md5("content").alias("digest"))
    return m.unionByName(m.where("created_at_ms % 2 = 0")).dropDuplicates(["session_id", "created_at_ms", "role", "digest"]).orderBy("created_at_ms", "role", "digest").limit(300)


O["session_messages"] = sql("messages", "select distinct session_id, created_at_ms, role, md5(content) as digest from messages where role <> '__runtime_command__' order by created_at_ms, role, digest limit 300")


def session_page(spark, d):
    """A page of each session with the total."""
    w = Window.partitionBy("session_id")
    m = _shown(spark, d).withColumn("total", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy("turn")))
    return m.where("n > 1 and n <= 4").select("session_id", "turn", "role", "total")


O["session_page"] = sql("messages", "select session_id, turn, role, total from (select *, count(*) over (partition by session_id) as total, row_number() over (partition by session_id order by turn) as n from messages where role <> '__runtime_command__') where n between 2 and 4")


def usage_max(spark, d):
    m = _shown(spark, d).groupBy("session_id").agg(F.sum(F.octet_length("content")).alias("used"))
    return m.agg(F.max("used").alias("most"))


O["usage_max"] = sql("messages", "select max(u)::bigint as most from (select sum(strlen(content)) as u from messages where role <> '__runtime_command__' group by session_id)")


def recall_signals(spark, d):
    f = S.feed(spark, d)
    return f.groupBy("object_id", "actor_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"), F.round(F.sum("value"), 4).alias("total"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


O["recall_signals"] = sql("feed", "select object_id, actor_id, count(*) as n, round(max(value), 6) as top, round(sum(value), 4) as total, min(ts_ms) as first_ms, max(ts_ms) as last_ms from feed group by 1, 2")


def _aged(spark, d):
    a = S.atoms(spark, d)
    now = a.agg(F.max("verified_at_ms").alias("now"))
    return a.join(F.broadcast(now))  # one row


def hygiene_decisions(spark, d):
    return _aged(spark, d).select("id", L.hygiene(F.col("status"), F.col("verified_at_ms"), F.col("now")).alias("decision"))


_HYG = f"select id, case when status in ('deprecated', 'rejected') then 'archive' when age > 365 * 86400000 then 'purge' when age > 90 * 86400000 then 'archive' when age > 30 * 86400000 then 'mark_stale' else 'keep' end as decision from (select *, coalesce(greatest({_NOW} - verified_at_ms, 0), 0) as age from atoms)".replace("86400000", "86400000::bigint")
O["hygiene_decisions"] = sql("atoms", _HYG)


def hygiene_report(spark, d):
    return hygiene_decisions(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


O["hygiene_report"] = sql("atoms", f"select decision, count(*) as n from ({_HYG}) group by 1")


def dedupe_atoms(spark, d):
    """Claims of one scope, permissions, predicate, object and content: the best status stays, then the latest seen. Winner and count are partial aggregates."""
    a = S.atoms(spark, d).where("permissions is not null and length(trim(text)) > 0")
    best = F.struct(L.status_rank(F.col("status")).alias("rank"), F.coalesce("verified_at_ms", "created_at_ms").alias("seen"))
    key = ["scope", F.to_json("permissions").alias("p"), "predicate", "object", X.normalized_content(F.col("text")).alias("t")]
    w = a.select(*key, "id", best.alias("best")).groupBy("scope", "p", "predicate", "object", "t").agg(F.min(F.struct((-F.col("best.rank")).alias("r"), (-F.col("best.seen")).alias("s"), "id")).alias("x"), F.count("*").alias("copies"))
    return w.select("x.id", "copies")


O["dedupe_atoms"] = sql("atoms", "select id, copies from (select id, count(*) over (partition by scope, array_to_string(permissions, '|'), object, text) as copies, row_number() over (partition by scope, array_to_string(permissions, '|'), object, text order by case when status = 'verified' then 4 when status = 'proposed' then 3 when status = 'stale' then 2 else 1 end desc, coalesce(verified_at_ms, created_at_ms) desc, id) as n from atoms where permissions is not null) where n = 1")


def conflict_scan(spark, d):
    """Pairs of visible claims of one scope and predicate that state different objects of one subject; a claim without a subject meets all of its scope's.

    Claims that say the same are one class, named by its least id and with its size, and classes are paired: a subject has few objects, and those
    without a subject are one class an object, so pairs grow with the number of classes.
    """
    a = S.atoms(spark, d).where(A.record_visible(F.col("scope"), F.col("permissions"), ME) & A.status_shown(F.col("status")))
    a = a.groupBy("scope", "predicate", F.when(F.col("key") % 400 > 0, F.col("subject")).alias("subject"), "object").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    a = staged(spark, a, "classes")
    left, right = (a.select(*(F.col(c).alias(f"{s}_{c}") for c in a.columns)) for s in "ab")
    same = (F.col("a_scope") == F.col("b_scope")) & (F.col("a_predicate") == F.col("b_predicate")) & (F.col("a_object") != F.col("b_object"))
    equal = left.join(right, same & (F.col("a_subject") == F.col("b_subject")) & (F.col("a_key") < F.col("b_key")))
    open_ = left.where("a_subject is null").join(right, same & (F.col("b_subject").isNotNull() | (F.col("a_key") < F.col("b_key"))))
    both = equal.unionByName(open_)
    first = F.col("a_key") < F.col("b_key")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select(F.concat(F.lit("mem_"), pick("a_key", "b_key")).alias("a_id"), F.concat(F.lit("mem_"), pick("b_key", "a_key")).alias("b_id"), pick("a_n", "b_n").alias("a_claims"), pick("b_n", "a_n").alias("b_claims"))


_SHOWN = "status not in ('rejected', 'deprecated', 'superseded')"
_CLASSES = f"c as (select scope, predicate, case when key % 400 > 0 then subject end as subject, object, min(key) as key, count(*) as n from atoms where {_SEEN} and {_SHOWN} group by 1, 2, 3, 4)"
O["conflict_scan"] = sql("atoms", "").rstrip() + f", {_CLASSES} select 'mem_' || x.key as a_id, 'mem_' || y.key as b_id, x.n as a_claims, y.n as b_claims from c x join c y on x.scope = y.scope and x.predicate = y.predicate and x.object <> y.object and x.key < y.key and (x.subject = y.subject or x.subject is null or y.subject is null)"


def conflict_members(spark, d):
    """The class, by its least claim, of each visible claim."""
    a = S.atoms(spark, d).where(A.record_visible(F.col("scope"), F.col("permissions"), ME) & A.status_shown(F.col("status"))).withColumn("subject", F.when(F.col("key") % 400 > 0, F.col("subject")))
    by = ["scope", "predicate", "subject", "object"]
    first = a.groupBy(*by).agg(F.min("key").alias("first")).select(*(F.col(c).alias("c_" + c) for c in by), "first")
    match = a["scope"] == F.col("c_scope")
    for c in by[1:]:
        match = match & a[c].eqNullSafe(F.col("c_" + c))
    return a.join(first, match).select("id", F.concat(F.lit("mem_"), "first").alias("class_id"))


O["conflict_members"] = sql("atoms", f"select id, 'mem_' || min(key) over (partition by scope, predicate, case when key % 400 > 0 then subject end, object) as class_id from atoms where {_SEEN} and {_SHOWN}")


def _cache(spark, d):
    return S.feed(spark, d).select("id", "actor_id", F.col("ts_ms").alias("created"), F.when(F.col("id") % 3 == 0, 0).otherwise(86_400_000 * 30).alias("ttl"), (F.col("id") % 4).alias("hits"), (F.col("id") % 100).alias("tokens"))


_CACHE = "cache as (select id, actor_id, ts_ms as created, case when id % 3 = 0 then 0 else 86400000::bigint * 30 end as ttl, id % 4 as hits, id % 100 as tokens from feed)"


def _with_now(df, column: str):
    return df.join(F.broadcast(df.agg(F.max(column).alias("now"))))  # one row


def cache_freshness(spark, d):
    return _with_now(_cache(spark, d), "created").select("id", L.fresh(F.col("created"), F.col("ttl"), F.col("now")).alias("fresh"))


O["cache_freshness"] = sql("feed", "").rstrip() + f", {_CACHE} select id, ttl <= 0 or (select max(created) from cache) <= created + ttl as fresh from cache"


def cache_stats(spark, d):
    c = _with_now(_cache(spark, d), "created")
    return c.agg(F.count("*").alias("entries"), F.count_if(~L.fresh(F.col("created"), F.col("ttl"), F.col("now"))).alias("expired"), F.sum("hits").alias("hits"), F.sum(F.col("hits") * F.col("tokens")).alias("saved"))


O["cache_stats"] = sql("feed", "").rstrip() + f", {_CACHE} select count(*) as entries, count(*) filter (where not (ttl <= 0 or (select max(created) from cache) <= created + ttl)) as expired, sum(hits)::bigint as hits, sum(hits * tokens)::bigint as saved from cache"


def lru_evict(spark, d, most: int = 5):
    """The newest entries of each actor stay."""
    w = Window.partitionBy("actor_id").orderBy(F.desc("created"), F.desc("id"))
    return _cache(spark, d).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("actor_id", "id")


O["lru_evict"] = sql("feed", "").rstrip() + f", {_CACHE} select actor_id, id from cache qualify row_number() over (partition by actor_id order by created desc, id desc) <= 5"


def rollout(spark, d):
    """Mode of each source: refused scopes, then a bucket of 100 from the digest of its id."""
    bucket = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 100
    return S.sources(spark, d).select("id", F.when(F.col("scope").startswith("session:"), "off").when(bucket < 25, "on").when(bucket < 50, "shadow").otherwise("off").alias("mode"))


O["rollout"] = sql("sources", "select id, case when starts_with(scope, 'session:') then 'off' when b < 25 then 'on' when b < 50 then 'shadow' else 'off' end as mode from (select id, scope, ('0x' || substr(md5(id), 1, 8))::bigint % 100 as b from sources)")


def artifact_validate(spark, d):
    types = list(L.ARTIFACT_STATUSES)
    statuses = ["draft", "accepted", "stale", "verified"]
    k = F.col("key")
    pick = lambda xs, e: F.element_at(F.array(*map(F.lit, xs)), (e % len(xs) + 1).cast("int"))
    rules = spark.createDataFrame([(t, s) for t, ss in L.ARTIFACT_STATUSES.items() for s in ss], "type string, status string").withColumn("valid", F.lit(True))
    s = S.sources(spark, d).select("id", pick(types, k).alias("type"), pick(statuses, F.floor(k / 3)).alias("status"))
    return s.join(F.broadcast(rules), ["type", "status"], "left").select("id", "type", "status", F.coalesce("valid", F.lit(False)).alias("valid"))  # a fixed table


_t = "[" + ", ".join(f"'{t}'" for t in L.ARTIFACT_STATUSES) + "]"
O["artifact_validate"] = sql("sources", f"select id, type, status, case type " + " ".join(f"when '{t}' then status in ({', '.join(repr(s) for s in ss)})" for t, ss in L.ARTIFACT_STATUSES.items()) + f" end as valid from (select id, {_t}[key % {len(L.ARTIFACT_STATUSES)} + 1] as type, ['draft', 'accepted', 'stale', 'verified'][(key // 3) % 4 + 1] as status from sources)")


def route_parse(spark, d):
    names = [*L.ROUTES, "mem0", "lru,native"]
    k = F.col("key")
    r = S.sources(spark, d).select("id", F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias("r"))
    known = F.create_map(*(F.lit(x) for p in L.ROUTES.items() for x in p))
    return r.select("id", F.coalesce(F.try_element_at(known, F.col("r")), F.when(F.col("r").contains(","), "subset").otherwise("named")).alias("route"))


_names = [*L.ROUTES, "mem0", "lru,native"]
_known = " ".join(f"when '{a}' then '{b}'" for a, b in L.ROUTES.items())
O["route_parse"] = sql("sources", f"select id, case r {_known} else case when contains(r, ',') then 'subset' else 'named' end end as route from (select id, [" + ", ".join(f"'{n}'" for n in _names) + f"][key % {len(_names)} + 1] as r from sources)")


def diagnostics(spark, d):
    """Counts of claims by state and whether too many are stale."""
    a = S.atoms(spark, d)
    n = lambda c: F.count_if(c)
    g = a.agg(F.count("*").alias("atoms"), n(F.col("status") == "verified").alias("verified"), n(F.col("status") == "proposed").alias("proposed"), n(F.col("status") == "stale").alias("stale"), n(F.col("status").isin("deprecated", "rejected")).alias("withdrawn"), n(F.col("permissions").isNull()).alias("malformed"), n(F.col("verified_at_ms").isNull()).alias("never_verified"))
    return g.withColumn("health", F.when(F.col("stale") > F.col("atoms") / 2, "needs_review").when(F.col("malformed") > 0, "degraded").otherwise("ok"))


O["diagnostics"] = sql("atoms", "select count(*) as atoms, count(*) filter (where status = 'verified') as verified, count(*) filter (where status = 'proposed') as proposed, count(*) filter (where status = 'stale') as stale, count(*) filter (where status in ('deprecated', 'rejected')) as withdrawn, count(*) filter (where permissions is null) as malformed, count(*) filter (where verified_at_ms is null) as never_verified, case when count(*) filter (where status = 'stale') > count(*) / 2 then 'needs_review' when count(*) filter (where permissions is null) > 0 then 'degraded' else 'ok' end as health from atoms")


def export_jsonl(spark, d):
    """Records as JSON lines."""
    return S.atoms(spark, d).select("id", F.to_json(F.struct("id", "predicate", "object", "status")).alias("line"))


O["export_jsonl"] = sql("atoms", "select id, '{\"id\":\"' || id || '\",\"predicate\":\"' || predicate || '\",\"object\":\"' || object || '\",\"status\":\"' || status || '\"}' as line from atoms")

for _f in (feed_since, feed_dedupe, agent_memory_state, tombstones, feed_operations, lifecycle_status, feed_frontier, feed_compact, feed_status, feed_redaction, agent_memory_reduce, merge_object, merge_string_set, analytics_status, analytics_final, analytics_query, analytics_export, analytics_cursor, outbox_status, outbox_claims, job_claims, job_counts, feed_restore, session_history, session_merge, session_messages, session_page, usage_max, recall_signals, hygiene_decisions, hygiene_report, dedupe_atoms, conflict_scan, conflict_members, cache_freshness, cache_stats, lru_evict, rollout, artifact_validate, route_parse, diagnostics, export_jsonl):
    Q[_f.__name__] = _f
