"""Vector search, signatures, caches and codecs over the embeddings."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from cairn.functions import lexical as L
from cairn.functions import vectors as V
from cairn.operators import greedy
from cairn.operators import vector_index as I
from cairn.sources import tables as S
from cairn.sources.tables import NOW, sql

DIMS = 64
Q, O = {}, {}
_E = "embedding::double[]"
_COS = "greatest(0.0, least(1.0, coalesce(list_cosine_similarity({a}, {b}), 0.0)))"


def vectors(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _query(spark, d, vec_id: int = 0) -> list[float]:
    row = vectors(spark, d).where(F.col("id") == vec_id).select("v").first()
    return [float(x) for x in row["v"]]


def _scored(spark, d, vec_id: int = 0):
    q = F.array(*map(F.lit, _query(spark, d, vec_id)))
    return vectors(spark, d).select("id", "v", "label", V.cosine(F.col("v"), q).alias("score"))


def cosine_similarity(spark, d):
    return _scored(spark, d).select("id", F.round("score", 6).alias("score"))


_Q0 = "(select embedding::double[] from embeddings where vec_id = 0)"
_SC = f"sc as (select vec_id as id, label, {_COS.format(a=_E, b=_Q0)} as score from embeddings)"
O["cosine_similarity"] = f"with {_SC} select id, round(score, 6) as score from sc"


def vector_topk(spark, d):
    return _scored(spark, d).where("score > 0").orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


O["vector_topk"] = f"with {_SC} select id, round(score, 6) as score from sc where sc.score > 0 order by sc.score desc, id limit 20"


def vector_normalize(spark, d):
    n = V.normalized(F.col("v"))
    return vectors(spark, d).select("id", F.round(n[0], 6).alias("first"), F.round(V.norm(n), 6).alias("norm"))


O["vector_normalize"] = f"select vec_id as id, round(embedding[1]::double / sqrt(list_dot_product({_E}, {_E})), 6) as first, 1.0::double as norm from embeddings"


def _signed(spark, d):
    return V.signatures(vectors(spark, d), DIMS)


def simhash(spark, d):
    return _signed(spark, d).select("id", F.shiftrightunsigned("sig", 32).alias("high"), F.col("sig").bitwiseAND(0xFFFFFFFF).alias("low"))


def _half(bits: range) -> str:
    m = V.projection(DIMS)
    return " + ".join(f"(case when list_dot_product({_E}, [{', '.join(repr(float(x)) for x in m[b])}]::double[]) >= 0 then {1 << (b - bits[0])} else 0 end)" for b in bits)


O["simhash"] = f"select vec_id as id, {_half(range(32, 64))} as high, {_half(range(32))} as low from embeddings"


def simhash_bands(spark, d):
    return _signed(spark, d).select("id", *(b.alias(f"band{i}") for i, b in enumerate(V.bands(F.col("sig")))))


_BANDS = "bands as (select vec_id as id, " + ", ".join(f"{_half(range(16 * i, 16 * i + 16))} as band{i}" for i in range(4)) + " from embeddings)"
O["simhash_bands"] = f"with {_BANDS} select * from bands"


def lsh_candidates(spark, d):
    """Pairs that share a band: one in twenty vectors against all."""
    keyed = simhash_bands(spark, d).select("id", F.posexplode(F.array(*(f"band{i}" for i in range(4)))).alias("band", "value"))
    asked = keyed.where("id % 20 = 0").withColumnRenamed("id", "query")
    return asked.join(keyed, ["band", "value"]).where("query <> id").select("query", "id").distinct()


O["lsh_candidates"] = f"with {_BANDS}, k as (" + " union all ".join(f"select id, {i} as b, band{i} as v from bands" for i in range(4)) + ") select distinct q.id as query, k.id from k as q join k on q.b = k.b and q.v = k.v where q.id % 20 = 0 and q.id <> k.id"


def ann_search(spark, d, limit: int = 10):
    """For every twentieth vector those nearest: among all whose signatures are within I.WITHIN bits, found by the buckets of a written index, where these settle the query; else among all."""
    rows = vectors(spark, d).select("id", "v")
    return I.nearest(I.build(rows, DIMS), rows.where("id % 20 = 0"), limit).select("query", "id", F.round("score", 6).alias("score"))


_S = f"s as (select vec_id as id, {_E} as v, {_half(range(32, 64))} as high, {_half(range(32))} as low from embeddings)"
_PAIRS = f"p as (select q.id as query, x.id, {_COS.format(a='q.v', b='x.v')} as score, bit_count(xor(q.high, x.high)) + bit_count(xor(q.low, x.low)) <= {I.WITHIN} as near from s q, s x where q.id % 20 = 0)"
O["ann_search"] = f"with {_S}, {_PAIRS}, n as (select query, score, row_number() over (partition by query order by p.score desc, id) as place from p where near and p.score > 0), e as (select query from n where place = 10 and n.score >= {I.least_sure()}) select query, id, round(score, 6) as score from p where p.score > 0 and (near or query not in (select query from e)) qualify row_number() over (partition by query order by p.score desc, id) <= 10"


def vector_min_score(spark, d):
    """Rows whose score a least score admits, by three least scores; none asked, all pass."""
    s = _scored(spark, d)
    return s.agg(*(F.count_if(L.vector_score_allowed(F.col("score"), least)).alias(name) for name, least in (("any", 0.0), ("some", 0.1), ("few", 0.3))))


O["vector_min_score"] = f"with {_SC} select count(*) as \"any\", count(*) filter (where score >= 0.1) as some, count(*) filter (where score >= 0.3) as few from sc"


def embedding_parse(spark, d):
    """Vectors to JSON and back; only finite ones."""
    text = vectors(spark, d).select("id", F.to_json("v").alias("json"))
    back = F.from_json("json", "array<float>")
    return text.select("id", F.size(back).cast("long").alias("n"), F.forall(back, lambda x: ~F.isnan(x)).alias("finite"), F.round(F.element_at(back, 1).cast("double"), 5).alias("first"))


O["embedding_parse"] = "select vec_id as id, len(embedding) as n, len(list_filter(embedding, lambda x: isnan(x))) = 0 as finite, round(embedding[1]::double, 5) as first from embeddings"


def chunk_id_codec(spark, d):
    """vec:<length of type>:<type>:<id>:<ordinal>, and back."""
    s = S.sources(spark, d).select("id", "type", "key")
    code = s.select("id", F.concat(F.lit("vec:"), F.octet_length("type").cast("string"), F.lit(":"), "type", F.lit(":"), "id", F.lit(":"), (F.col("key") % 7).cast("string")).alias("code"))
    return code.select("id", "code", F.regexp_extract("code", r"^vec:\d+:([^:]+):(.*):(\d+)$", 1).alias("type"), F.regexp_extract("code", r":(\d+)$", 1).cast("int").alias("ordinal"))


O["chunk_id_codec"] = sql("sources", "select id, 'vec:' || strlen(type) || ':' || type || ':' || id || ':' || (key % 7) as code, type, (key % 7)::int as ordinal from sources")


def vector_text(spark, d):
    """What is embedded of a claim."""
    return S.atoms(spark, d).select("id", F.concat_ws("\n", "subject", "predicate", "object", "text").alias("text"))


O["vector_text"] = sql("atoms", "select id, concat_ws(chr(10), subject, predicate, object, text) as text from atoms")


CACHE_LEAST = 0.82


def semantic_cache(spark, d, least: float = CACHE_LEAST):
    """The best fresh answer of the same provider whose cosine reaches the least score; of equals the later wins. The query is a cached vector with one part changed."""
    q = F.array(*(F.lit(x + (0.05 if i == 0 else 0.0)) for i, x in enumerate(_query(spark, d, 1))))
    c = vectors(spark, d).select("id", "label", V.cosine(F.col("v"), q).alias("score")).withColumn("created", F.lit(NOW) - F.col("id") * 1000).withColumn("ttl", F.when(F.col("id") % 3 == 0, 0).otherwise(400000)).where("label % 2 = 1 or label = 0")
    fresh = (F.col("ttl") <= 0) | (F.lit(NOW) <= F.col("created") + F.col("ttl"))
    return c.where(fresh & L.vector_score_allowed(F.col("score"), least)).orderBy(F.desc("score"), F.desc("created")).limit(1).select("id", F.round("score", 6).alias("score"))


_Q1 = "(select list_prepend(embedding[1]::double + 0.05, embedding[2:]::double[]) from embeddings where vec_id = 1)"
_SC1 = f"sc as (select vec_id as id, label, {_COS.format(a=_E, b=_Q1)} as score from embeddings)"
O["semantic_cache"] = f"with {_SC1} select id, round(score, 6) as score from sc where (label % 2 = 1 or label = 0) and (id % 3 = 0 or {NOW} <= {NOW} - id * 1000 + 400000) and sc.score >= {CACHE_LEAST} order by sc.score desc, id limit 1"


def vector_orphans(spark, d):
    """Chunks whose object is gone."""
    return vectors(spark, d).join(S.table(spark, d, "documents").select(F.col("doc_id").alias("id")).where("id % 3 > 0"), "id", "left_anti").select("id")


O["vector_orphans"] = "select vec_id as id from embeddings where vec_id not in (select doc_id from documents where doc_id % 3 > 0)"


def vector_reconcile(spark, d):
    """Objects to embed and chunks to delete."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id")).where("id % 3 > 0")
    have = vectors(spark, d).select("id")
    return docs.join(have, "id", "left_anti").withColumn("action", F.lit("embed")).unionByName(have.join(docs, "id", "left_anti").withColumn("action", F.lit("delete")))


O["vector_reconcile"] = "with docs as (select doc_id as id from documents where doc_id % 3 > 0), have as (select vec_id as id from embeddings) select id, 'embed' as action from docs where id not in (select id from have) union all select id, 'delete' from have where id not in (select id from docs)"


def mmr(spark, d):
    top = _scored(spark, d, 2).where("score > 0").orderBy(F.desc("score"), "id").limit(80).select(F.lit(1).alias("q"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), "score", F.col("v").alias("embedding"))
    return greedy.mmr(top, _query(spark, d, 2), 20).select("id", "place", F.round("adjusted", 6).alias("score"))


def hash_embedding(spark, d, dims: int = 64):
    """Counts of hashed words, scaled to length one. Words are hashed by CRC-32."""

    def run(batches):
        import numpy as np

        for b in batches:
            out = np.zeros((b.num_rows, dims))
            for i, t in enumerate(b.column("text").to_pylist()):
                for w in t.lower().split():
                    out[i, zlib.crc32(w.encode()) % dims] += 1
            n = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(n > 0, n, 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dims).cast(pa.list_(pa.float64()))], names=["id", "v"])

    return S.sources(spark, d).select("id", "text").mapInArrow(run, "id string, v array<double>").select("id", F.round(F.array_max("v"), 6).alias("top"), F.size("v").alias("dims"))


for _f in (cosine_similarity, vector_topk, vector_normalize, simhash, simhash_bands, lsh_candidates, ann_search, vector_min_score, embedding_parse, chunk_id_codec, vector_text, semantic_cache, vector_orphans, vector_reconcile, mmr, hash_embedding):
    Q[_f.__name__] = _f
