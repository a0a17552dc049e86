"""Search for a table of queries: each with its own tokens, plan, vector, windows and session, answered together as joins with the written indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import lexical as L
from cairn.operators import postings as P
from cairn.operators import token_scan as T
from cairn.operators import vector_index as I
from cairn.plans.access import _SEEN
from cairn.plans.indexes import vector_index, visible
from cairn.plans.vectors import _COS, _E, _half
from cairn.sources import tables as S
from cairn.sources.staging import kept_index, staged
from cairn.sources.tables import NOW, sql

RRF_K, RRF_WEIGHT, RAW_WEIGHT, LEAST = 60, 0.85, 0.15, 0.01
#: the widest window that a query of the table asks of a channel
WIDEST = max(L.Windows(limit=5 + 5 * j, offset=i).candidates for i in range(3) for j in range(4))
Q, O = {}, {}


def asked(spark, d) -> DataFrame:
    """Every twentieth source as a query: its first words, some with a question word before them, its own vector, page and session; with the query's plan."""
    k = (F.col("key") / 20).cast("long")
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")
    s = S.sources(spark, d).where("key % 20 = 0").select("key", k.alias("k"), F.array_join(F.slice(words, F.lit(1), (k % 9).cast("int") + 1), " ").alias("first"))
    q = s.select(F.col("key").alias("query"), "k", F.when(F.col("k") % 3 == 0, F.concat(F.lit("How "), "first")).otherwise(F.col("first")).alias("q"))
    q = q.withColumn("page", (5 + F.col("k") % 4 * 5).cast("int")).withColumn("offset", (F.col("k") % 3).cast("int")).withColumn("session", F.concat(F.lit("session:sess_"), (F.col("k") % 3).cast("string")))
    q = q.withColumn("wide", F.col("offset") + F.col("page") * L.Windows(limit=1).mmr_multiplier).withColumn("tokens", P.query_terms(F.col("q"))).withColumn("strategy", L.strategy(F.col("q")))
    have = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("query"), F.lit(True).alias("has_vector"))
    q = q.join(have, "query", "left")
    keyword = (F.col("strategy") != "vector_only") & (F.size("tokens") > 0)
    vector = (F.col("strategy") != "keyword_only") & F.coalesce("has_vector", F.lit(False)) & (F.length("q") > 8)
    return q.withColumn("use_keyword", keyword).withColumn("use_vector", vector).drop("has_vector")


def channels(spark, d, queries: DataFrame) -> DataFrame:
    """(query, id, rank, score): each query's best of the channels that its plan asks for, as many as its window takes."""
    docs = kept_index(spark, "seen_terms", [f"{d}/documents.parquet"], lambda: T.documents(visible(spark, d).select(F.col("key").alias("id"), F.col("confidence").alias("first"), F.col("created_at_ms").alias("second"), "text")))
    kw = T.most_tokens(docs, queries.where("use_keyword").select("query", "tokens", F.least("wide", F.lit(WIDEST)).alias("most")))
    vectors = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    ask = vectors.join(queries.where("use_vector").select(F.col("query").alias("id")), "id", "left_semi")
    near = I.nearest(vector_index(spark, d), ask, WIDEST).join(queries.select("query", "wide"), "query")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= F.col("wide"))
    return kw.select("query", "id", "rank", "score").unionByName(near.select("query", "id", "rank", "score"))


def ranked(spark, d, queries: DataFrame) -> DataFrame:
    """(query, id, score, confidence, created_at_ms): fused, of open sessions or the query's own, relevant, decayed, boosted; before the page is cut."""
    fused = channels(spark, d, queries).groupBy("query", "id").agg(F.sum(1 / (F.lit(float(RRF_K)) + F.col("rank"))).alias("rrf"), F.max("score").alias("raw"))
    lists = F.col("use_keyword").cast("int") + F.col("use_vector").cast("int")
    fused = fused.withColumn("top", F.max("raw").over(Window.partitionBy("query"))).join(queries.select("query", "q", "session", lists.alias("lists")), "query")
    fused = fused.withColumn("score", (RRF_WEIGHT * F.col("rrf") / (F.col("lists") / F.lit(RRF_K + 1.0)) + RAW_WEIGHT * F.col("raw") / F.col("top")) / (RRF_WEIGHT + RAW_WEIGHT)).where(F.col("score") >= LEAST)
    s = visible(spark, d).select(F.col("key").alias("id"), "scope", "confidence", "created_at_ms", "text")
    both = fused.join(s, "id").where(~F.col("scope").startswith("session:") | (F.col("scope") == F.col("session")))
    phrase = F.lower(F.trim("q"))
    boost = F.when((F.octet_length(phrase) >= 3) & phrase.contains(" ") & F.lower("text").contains(phrase), 0.35).otherwise(0.0)
    return both.select("query", "id", (L.decayed(F.col("score"), F.lit(NOW) - F.col("created_at_ms")) + boost).alias("score"), "confidence", "created_at_ms")


def search_batch(spark, d):
    """The page of every query of the table."""
    queries = staged(spark, asked(spark, d), "queries")
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.desc("confidence"), F.desc("created_at_ms"), "id")
    rows = ranked(spark, d, queries).withColumn("place", F.row_number().over(best)).join(queries.select("query", "page", "offset"), "query")
    return rows.where((F.col("place") > F.col("offset")) & (F.col("place") <= F.col("offset") + F.col("page"))).select("query", "place", "id", F.round("score", 6).alias("score"))


_T = f"translate({{}}, '{L.UPPER}', '{L.LOWER}')"
_STOP = ", ".join(f"'{w}'" for w in sorted(L.STOP_WORDS))
_WORD = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_ISQ = "(regexp_matches(q, '(?i)^[ \\t\\r\\n]*(?:" + "|".join(L.QUESTION_WORDS) + ") ') or regexp_matches(q, '^[ \\t\\r\\n]*(?:" + "|".join(L.QUESTION_WORDS_CYRILLIC) + ") '))"
_N = "len(regexp_extract_all(q, '[^ \\t\\r\\n]+'))"
_ASKED = f"""a0 as (select key as query, key // 20 as k, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> ''), 1, (key // 20) % 9 + 1), ' ') as f from sources where key % 20 = 0),
a1 as (select query, k, case when k % 3 = 0 then 'How ' || f else f end as q, 5 + k % 4 * 5 as page, k % 3 as off, 'session:sess_' || (k % 3) as session from a0),
a2 as (select *, off + page * 4 as wide, list_filter(regexp_extract_all({_T.format('q')}, '{_WORD}'), lambda x: x not in ({_STOP})) as w, case when {_N} = 0 then 'keyword_only' when regexp_matches(q, '[_./\\\\:-]') then 'keyword_only' when {_N} <= 3 then 'keyword_only' when {_ISQ} and {_N} >= 6 then 'vector_only' else 'hybrid' end as strategy from a1),
asked as (select *, strategy <> 'vector_only' and len(w) > 0 as use_kw, strategy <> 'keyword_only' and query in (select vec_id from embeddings) and length(q) > 8 as use_vec from a2),
seen as (select key, text, scope, created_at_ms, key % 100 / 100 as confidence from sources where {_SEEN})"""
_CHANNELS = f"""tok as (select distinct query, wide, unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:64]) as token from asked where use_kw),
term as (select distinct key, unnest(regexp_extract_all({_T.format('text')}, '{_WORD}')) as term from seen),
kw as (select query, wide, key, count(distinct token)::double as score from tok join term on starts_with(term, token) group by 1, 2, 3),
kr as (select query, wide, key, score, row_number() over (partition by query order by score desc, confidence desc, created_at_ms desc, key) as rank from kw join seen using (key)),
sv as (select vec_id, {_E} as v, {_half(range(32, 64))} as high, {_half(range(32))} as low from embeddings),
vp as (select x.query, wide, y.vec_id as key, {_COS.format(a='u.v', b='y.v')} as score, bit_count(xor(u.high, y.high)) + bit_count(xor(u.low, y.low)) <= {I.WITHIN} as near from asked x join sv u on u.vec_id = x.query join sv y on y.vec_id in (select key from seen) where use_vec),
vn as (select query, score, row_number() over (partition by query order by vp.score desc, key) as place from vp where near and vp.score > 0),
ve as (select query from vn where place = {WIDEST} and vn.score >= {I.least_sure()}),
vr as (select query, wide, key, score, row_number() over (partition by query order by vp.score desc, key) as rank from vp where vp.score > 0 and (near or query not in (select query from ve))),
ch as (select query, key, rank, score from kr where rank <= wide union all select query, key, rank, score from vr where rank <= wide and rank <= {WIDEST})"""
_FINAL = f"""fu as (select query, key, sum(1 / ({RRF_K}.0 + rank)) as rrf, max(score) as raw from ch group by 1, 2),
fs as (select fu.*, q, page, off, session, ({RRF_WEIGHT} * rrf / ((use_kw::int + use_vec::int) / {RRF_K + 1}.0) + {RAW_WEIGHT} * raw / max(raw) over (partition by query)) / {RRF_WEIGHT + RAW_WEIGHT} as score from fu join asked using (query)),
fin as (select query, key, page, off, confidence, created_at_ms, fs.score * pow(0.5, ({NOW} - created_at_ms) / 86400000.0 / 30.0) + case when strlen(lower(trim(q))) >= 3 and contains(lower(trim(q)), ' ') and contains(lower(text), lower(trim(q))) then 0.35 else 0.0 end as score from fs join seen using (key) where fs.score >= {LEAST} and (not starts_with(scope, 'session:') or scope = session)),
pl as (select *, row_number() over (partition by query order by round(fin.score, 9) desc, confidence desc, created_at_ms desc, key) as place from fin)"""
O["search_batch"] = sql("sources", "").rstrip() + f", {_ASKED},\n{_CHANNELS},\n{_FINAL} select query, place, key as id, round(score, 6) as score from pl where place > off and place <= off + page"
Q["search_batch"] = search_batch
