"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least `K`-word hash of each `WINDOW - K + 1` that follow each other (the last of equal ones), each kept once with its
place. So every run of WINDOW (13) words holds a fingerprint, the same one in a document as in an item: fingerprints of both are joined,
and each hit is extended word by word to both sides, up to the reach of a window. A hit whose shared run is WINDOW words or more is real, and
the words of these runs are just those that windows of the item cover. Items of fewer words are fingerprints of their own length.

A Bloom filter of the benchmark's fingerprints (of fixed size, so it can be broadcast whatever the benchmark's size; a full filter only lets more
through) keeps other fingerprints of documents out of the join. Fingerprints of items that agree in all words within reach are one
row of the join, so what many items share is compared once with each place of a document.

Null and empty texts have no words: no hits, not contaminated. Null and wordless items match nothing; repeated items count once an id.
Rows are judged one by one, equal rows alike; other columns are ignored; an empty benchmark leaves all documents clean.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import staged, table

WINDOW, K = 13, 7
SIDE = WINDOW - K  # words on each side of a fingerprint that a window with it can reach
BITS = 24
_FACTORS = (T.mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)).tolist()


def _words(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, word hashes, their documents) of each block."""
    for lo, hi, buf, starts in T.blocks(col):
        low = T.LOWER[buf]
        s, e = T.spans(T.ALNUM[low])
        yield lo, hi, T.hash_spans(low, s, e), T.owner(starts, s)


def _runs(h: np.ndarray, n: int, upto: int | None = None) -> np.ndarray:
    """Hash of the n words from each place on."""
    size = len(h) - (upto or n) + 1
    total = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        total += h[j : j + size] * np.uint64(_FACTORS[j])
    return T.mix(total)


def fingerprints(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint) of the runs of n words within one document: the winnowed ones for n = WINDOW, all for fewer words."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = doc[: len(h) - n + 1] == doc[n - 1 :]
    if n < WINDOW:
        at = np.flatnonzero(inside)
        return at, T.mix(_runs(h, n) + np.uint64(n))[at]
    grams = _runs(h, K)
    size = len(h) - WINDOW + 1
    least, place = grams[:size].copy(), np.zeros(size, np.int64)
    for j in range(1, WINDOW - K + 1):
        lower = grams[j : j + size] <= least  # of equal ones the last
        least[lower], place[lower] = grams[j : j + size][lower], j
    at = np.unique((np.arange(size) + place)[inside])
    return at, grams[at]


def around(h: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int, outside: int) -> np.ndarray:
    """Hashes of the words within reach of each fingerprint, a row each; beyond the document stands `outside`."""
    if n < WINDOW:
        return h[at[:, None] + np.arange(n)]
    to = at[:, None] + np.arange(-SIDE, K + SIDE)
    ok = (to >= 0) & (to < len(h))
    to = np.clip(to, 0, max(len(h) - 1, 0))
    return np.where(ok & (doc[to] == doc[at][:, None]), h[to], np.uint64(outside))


def _lists(words: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel().view(np.int64)))


def _item_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("item_id")
        for lo, hi, h, doc in _words(b.column("text")):
            n = T.count_by(doc, hi - lo)
            for length in sorted(set(np.minimum(n[n > 0], WINDOW).tolist())):
                own = np.minimum(n, WINDOW)[doc] == length
                at, fp = fingerprints(h[own], doc[own], length)
                item = doc[own][at] + lo
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), pa.array(np.full(len(at), length, np.int32)), pa.array(fp.view(np.int64)), _lists(around(h[own], doc[own], at, length, 1))], names=["item_id", "len", "fp", "words"])


def item_fingerprints(items: DataFrame) -> DataFrame:
    """Distinct (item_id, len, fp, words) of items (item_id, text); words are those within reach of the fingerprint."""
    named = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(_item_fingerprints, "item_id string, len int, fp long, words array<long>").distinct()


def bloom(fingerprints: DataFrame, bits: int = BITS) -> np.ndarray:
    """Filter of 2**bits bits over fp; two places a fingerprint."""
    place = F.explode(F.array(F.shiftrightunsigned("fp", 64 - bits), F.col("fp").bitwiseAND((1 << bits) - 1)))
    words = fingerprints.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()  # 2**bits / 64 rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _maybe(filter_: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(fp), bool)
    for p in (fp >> np.uint64(64 - bits), fp & np.uint64((1 << bits) - 1)):
        ok &= ((filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return ok


def scan(docs: DataFrame, filter_: np.ndarray, lengths: list[int], bits: int = BITS) -> DataFrame:
    """doc_id, n_words and the fingerprints that pass the filter, with their places and the words within reach."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, docs_, lens, fps, ats, words = np.zeros(b.num_rows, np.int64), [], [], [], [], []
            for lo, hi, h, doc in _words(b.column("text")):
                n_words[lo:hi] = T.count_by(doc, hi - lo)
                first = np.searchsorted(doc, np.arange(hi - lo))
                for n in lengths:
                    at, fp = fingerprints(h, doc, n)
                    ok = _maybe(shared.value, fp, bits)
                    at = at[ok]
                    docs_.append(doc[at] + lo)
                    lens.append(np.full(len(at), n, np.int32))
                    fps.append(fp[ok].view(np.int64))
                    ats.append(at - first[doc[at]])
                    words.append(_lists(around(h, doc, at, n, 0)))
            flat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            of = np.concatenate(docs_) if docs_ else np.zeros(0, np.int64)
            order = pa.array(np.argsort(of, kind="stable"))
            fields = {"len": flat(lens, pa.int32()), "fp": flat(fps, pa.int64()), "at": flat(ats, pa.int64()), "words": pa.concat_arrays(words) if words else pa.array([], pa.list_(pa.int64()))}
            hits = pa.StructArray.from_arrays([x.take(order) for x in fields.values()], names=list(fields))
            offs = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=b.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.ListArray.from_arrays(pa.array(offs), hits)], names=["doc_id", "n_words", "hits"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, hits array<struct<len: int, fp: long, at: long, words: array<long>>>")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared run around each joined fingerprint, where it is long enough."""
    for b in batches:
        if not b.num_rows:
            continue
        n, at = b.column("len").to_numpy(), b.column("at").to_numpy()
        lo, hi = at.copy(), at.copy()
        for length in set(n.tolist()):
            own = np.flatnonzero(n == length)
            mine, theirs = (b.column(c).take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1) for c in ("words", "theirs"))
            same = mine == theirs
            side, k = (SIDE, K) if length == WINDOW else (0, length)
            whole = same[:, side : side + k].all(axis=1)  # the fingerprint's own words
            left = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, side + k :], axis=1).sum(axis=1)
            ok = whole & (left + k + right >= length)
            lo[own], hi[own] = at[own] - left, np.where(ok, at[own] + k + right, at[own] - left)
        keep = pa.array(hi > lo)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("set"), pa.array(lo), pa.array(hi)], names=["row", "set", "lo", "hi"]).filter(keep)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    known = item_fingerprints(items).withColumn("set", F.xxhash64("len", "fp", "words"))
    known = staged(spark, known, "fingerprints")
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect())  # WINDOW values at most
    scanned = staged(spark, scan(docs, bloom(known), lengths).withColumn("row", F.monotonically_increasing_id()), "scanned")
    near = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.len", "h.fp", "h.at", "h.words")
    sets = known.groupBy("len", "fp", "set").agg(F.first("words").alias("theirs"))
    runs = near.join(sets, ["len", "fp"]).select("row", "set", "len", "at", "words", "theirs").mapInArrow(_extend, "row long, set long, lo long, hi long")
    runs = staged(spark, runs, "runs")
    spans = runs.groupBy("row", "lo", "hi").agg(F.lit(1)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))  # a document's own
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(x["lo"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["hi"]).alias("upto"))
    hit = spans.select("row", F.aggregate("spans", nothing, step, lambda acc: acc["n"]).alias("n_hit"))
    named = runs.select("row", "set").distinct().join(known.select("set", "item_id").distinct(), "set").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = hit.join(named, "row")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return scanned.drop("hits").join(both, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op4_decontaminate": op4_decontaminate}

#: windows as lists of words; a document's words are numbered and matched by joining on windows of each length
ORACLE_SQL = {
    "op4_decontaminate": """
with d as (select row_number() over () as r, doc_id, w from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents)),
i as (select item_id::varchar as item_id, w, least(len(w), 13) as n from (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null and text is not null) where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as s from (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from i)),
pl as (select r, k, n, array_to_string(w[k:k + n - 1], ' ') as s from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from d, (select distinct n from win) where len(w) >= n)),
met as (select r, k, pl.n, item_id from pl join win on pl.n = win.n and pl.s = win.s),
hit as (select r, count(distinct p) as n_hit from (select distinct r, unnest(generate_series(k, k + n - 1)) as p from met) group by r),
its as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from met) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (r) left join its using (r)"""
}
