"""The engine's record tables as projections of the fixture tables, in Spark and (for oracles) in SQL.

Every view is plain and deterministic: ids come from keys, scopes and permissions from their remainders, and the
present moment is the latest event or a fixed number, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_700_000_000_000
DAY = 86_400_000
NOW = EPOCH + 400 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix), col.cast("string"))


def scope_of(key: Column) -> Column:
    return F.when(key % 5 == 0, F.lit("public")).when(key % 5 == 4, text_of("session:sess_", key % 3)).otherwise(text_of("team:", key % 5))


def permissions_of(key: Column) -> Column:
    """Open for most rows, one grant for some, null (malformed) for a few."""
    return F.when(key % 11 == 3, F.lit(None)).when(key % 7 == 0, F.array(text_of("team:", key % 3))).when(key % 7 == 1, F.array(F.lit("actor:a1"), F.lit("team:9"))).otherwise(F.array()).cast("array<string>")


SCOPE = "case when {k} % 5 = 0 then 'public' when {k} % 5 = 4 then 'session:sess_' || ({k} % 3) else 'team:' || ({k} % 5) end"
PERMS = "case when {k} % 11 = 3 then null when {k} % 7 = 0 then ['team:' || ({k} % 3)] when {k} % 7 = 1 then ['actor:a1', 'team:9'] else []::varchar[] end"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(text_of("src_", k).alias("id"), k.alias("key"), F.coalesce("text", F.lit("")).alias("text"), "lang", F.col("source").alias("type"), scope_of(k).alias("scope"), permissions_of(k).alias("permissions"), (F.lit(EPOCH) + k * 60000).alias("created_at_ms"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(text_of("src_", F.col("doc_id")).alias("object_id"), F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 1, "verified").otherwise("stale").alias("status"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        text_of("mem_", k).alias("id"), k.alias("key"), text_of("cust_", F.col("o_custkey")).alias("subject"), F.lit("order_status").alias("predicate"), F.col("o_orderstatus").alias("object"),
        F.concat_ws(" ", F.lit("Order"), "o_orderpriority", F.lit("is"), "o_orderstatus").alias("text"), scope_of(F.col("o_custkey")).alias("scope"), permissions_of(k).alias("permissions"),
        F.when(k % 13 == 0, "deprecated").when(k % 13 == 1, "rejected").when(k % 3 == 0, "verified").when(k % 3 == 1, "proposed").otherwise("stale").alias("status"),
        F.when(k % 4 > 0, epoch_ms(F.col("o_orderdate"))).alias("verified_at_ms"), (F.col("o_totalprice") % 100 / 100).alias("confidence"), (F.lit(EPOCH) + k * 1000).alias("created_at_ms"),
    )


def epoch_ms(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, key, name, kind: table(spark, sf_dir, t).select(text_of(f"ent_{kind}_", F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.col(key).cast("long").alias("key"))
    both = one("region", "r_regionkey", "r_name", "region").unionByName(one("nation", "n_nationkey", "n_name", "nation")).unionByName(one("customer", "c_custkey", "c_name", "customer")).unionByName(one("supplier", "s_suppkey", "s_name", "supplier")).unionByName(one("part", "p_partkey", "p_name", "part"))
    return both.select("*", scope_of(F.col("key")).alias("scope"), permissions_of(F.col("key")).alias("permissions"))


def relations(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Edges; those of parts stand once, or for each line item."""
    n, c, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    up = lambda df, kind, key, to, to_key: df.select(text_of(f"ent_{kind}_", F.col(key)).alias("from_id"), text_of(f"ent_{to}_", F.col(to_key)).alias("to_id"), F.lit("belongs_to").alias("type"), F.lit(kind).alias("from_type"), F.lit(to).alias("to_type"), F.col(key).cast("long").alias("key"))
    p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    p = p.distinct() if once else p
    parts = p.select(text_of("ent_part_", F.col("l_partkey")).alias("from_id"), text_of("ent_supplier_", F.col("l_suppkey")).alias("to_id"), F.lit("depends_on").alias("type"), F.lit("part").alias("from_type"), F.lit("supplier").alias("to_type"), F.col("l_partkey").alias("key"))
    return up(n, "nation", "n_nationkey", "region", "n_regionkey").unionByName(up(c, "customer", "c_custkey", "nation", "c_nationkey")).unionByName(up(s, "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(parts)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(text_of("sess_", F.col("conv_id")).alias("session_id"), F.col("conv_id"), "turn", F.when((F.col("turn") % 9 == 8), "__runtime_command__").otherwise(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("content"), (F.lit(EPOCH) + F.col("conv_id") * 100000 + F.col("turn") * 1000).alias("created_at_ms"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed events; every tenth repeats the origin sequence of the event five before it."""
    return table(spark, sf_dir, "events").transform(feed_rows)


def feed_rows(e: DataFrame) -> DataFrame:
    k = F.col("event_id")
    seq = F.when(k % 10 == 9, k - 5).otherwise(k)
    return e.select(
        k.alias("id"), F.element_at(F.create_map(*sum(([F.lit(i), F.lit(t)] for i, t in enumerate(EVENT_TYPES)), [])), (k % len(EVENT_TYPES)).cast("int")).alias("event_type"), text_of("user_", F.col("user_id")).alias("actor_id"), text_of("key_", F.col("user_id") % 50).alias("object_id"), text_of("node-", seq % 3).alias("origin"), seq.alias("sequence"),
        F.concat(F.lit("origin:node-"), (seq % 3).cast("string"), F.lit(":"), seq.cast("string")).alias("dedupe_key"), epoch_ms(F.col("ts")).alias("ts_ms"), "value", "props", scope_of(k).alias("scope"), F.when(k % 4 == 0, "pending").when(k % 4 == 1, "applying").otherwise("applied").alias("status"),
    )


EVENT_TYPES = ("agent_memory.put", "agent_memory.merge_object", "agent_memory.merge_string_set", "agent_memory.delete", "source.created", "memory_atom.verified", "artifact.superseded")

_event_case = "case event_id % 7 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(EVENT_TYPES)) + " end"
SQL = {
    "sources": f"select 'src_' || doc_id as id, doc_id as key, coalesce(text, '') as text, lang, source as type, {SCOPE.format(k='doc_id')} as scope, {PERMS.format(k='doc_id')} as permissions, {EPOCH} + doc_id * 60000 as created_at_ms from documents",
    "lifecycle": "select 'src_' || doc_id as object_id, case when toxic = 1 then 'deprecated' when quality = 1 then 'verified' else 'stale' end as status from labels",
    "atoms": f"select 'mem_' || o_orderkey as id, o_orderkey as key, 'cust_' || o_custkey as subject, 'order_status' as predicate, o_orderstatus as object, concat_ws(' ', 'Order', o_orderpriority, 'is', o_orderstatus) as text, {SCOPE.format(k='o_custkey')} as scope, {PERMS.format(k='o_orderkey')} as permissions, case when o_orderkey % 13 = 0 then 'deprecated' when o_orderkey % 13 = 1 then 'rejected' when o_orderkey % 3 = 0 then 'verified' when o_orderkey % 3 = 1 then 'proposed' else 'stale' end as status, case when o_orderkey % 4 > 0 then epoch_us(o_orderdate) // 1000 end as verified_at_ms, o_totalprice % 100 / 100 as confidence, {EPOCH} + o_orderkey * 1000 as created_at_ms from orders",
    "entities": " union all ".join(
        f"select id, type, name, key, {SCOPE.format(k='key')} as scope, {PERMS.format(k='key')} as permissions from (select 'ent_{kind}_' || {key} as id, '{kind}' as type, {name} as name, {key}::bigint as key from {t})"
        for t, key, name, kind in (("region", "r_regionkey", "r_name", "region"), ("nation", "n_nationkey", "n_name", "nation"), ("customer", "c_custkey", "c_name", "customer"), ("supplier", "s_suppkey", "s_name", "supplier"), ("part", "p_partkey", "p_name", "part"))
    ),
    "relations": " union all ".join(
        f"select 'ent_{kind}_' || {key} as from_id, 'ent_{to}_' || {to_key} as to_id, 'belongs_to' as type, '{kind}' as from_type, '{to}' as to_type, {key}::bigint as key from {kind}"
        for kind, key, to, to_key in (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"))
    )
    + " union all select distinct 'ent_part_' || l_partkey, 'ent_supplier_' || l_suppkey, 'depends_on', 'part', 'supplier', l_partkey from lineitem",
    "messages": f"select 'sess_' || conv_id as session_id, conv_id, turn, case when turn % 9 = 8 then '__runtime_command__' else role end as role, coalesce(text, '') as content, {EPOCH} + conv_id * 100000 + turn * 1000 as created_at_ms from conversations",
    "feed": f"select event_id as id, {_event_case} as event_type, 'user_' || user_id as actor_id, 'key_' || (user_id % 50) as object_id, 'node-' || ((case when event_id % 10 = 9 then event_id - 5 else event_id end) % 3) as origin, case when event_id % 10 = 9 then event_id - 5 else event_id end as sequence, 'origin:node-' || ((case when event_id % 10 = 9 then event_id - 5 else event_id end) % 3) || ':' || (case when event_id % 10 = 9 then event_id - 5 else event_id end) as dedupe_key, epoch_us(ts) // 1000 as ts_ms, value, props, {SCOPE.format(k='event_id')} as scope, case when event_id % 4 = 0 then 'pending' when event_id % 4 = 1 then 'applying' else 'applied' end as status from events",
}


def sql(names: str, body: str) -> str:
    """body over the named views."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names.split()) + " " + body if names else body
