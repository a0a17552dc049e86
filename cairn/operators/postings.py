"""A written inverted index: postings in blocks by term, prefix matches and BM25 from them for tables of queries, no text read.

Terms are runs of letters, digits and all beyond ASCII, folded as search folds. A block holds up to BLOCK postings of one term (ids, counts, lengths of the documents), the best
first: blocks of a term fall in `bound`, the highest BM25 weight in them, without the term's rarity. Rows are ranged by term and weight, so a common
term takes many partitions, and files hold term ranges that filters on terms and prefixes skip by. `forward` has each document's terms for exact scores.

BM25 reads only what can matter. The weight that at least `limit` documents of one term reach gives a score that every result has; terms that cannot reach it even together are not
read, and of the others only blocks whose bound and all other terms' best would reach it. What these name is scored in full from `forward`. The result is that of
scoring every document: bounds only leave out what cannot be among the first.

Null texts are empty. Each id should stand once. Ties go by id; scores are rounded to 9 digits first, so that sums taken in another order stay equal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import lexical as L
from cairn.sources.staging import staged

K1, B, BLOCK = 1.2, 0.75, 128
#: texts whose terms a worker holds at once
ROWS = 256
#: numbers of results for which the index knows a weight that as many postings of a term reach
LADDER = (10, 100, 1000)
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")
_FOLD = str.maketrans(L.UPPER, L.LOWER)


@dataclass
class Postings:
    """forward (id, length, terms, tfs); blocks (term, bound, low, at, n, ids, tfs, lengths); terms (term, df, top, and for each of LADDER a weight or null)."""

    forward: DataFrame
    blocks: DataFrame
    terms: DataFrame
    docs: int
    mean: float


def term_list(text: Column) -> Column:
    """Terms of a text in order, as the index has them."""
    return F.regexp_extract_all(L.folded(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def query_terms(text: Column, most: int = 64) -> Column:
    """Distinct terms of a query in order, without stop words."""
    return F.slice(F.array_distinct(F.filter(term_list(text), lambda t: ~t.isin(sorted(L.STOP_WORDS)))), 1, most)


def weight(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def rarity(df: Column, docs: int) -> Column:
    return F.log((F.lit(docs) - df + 0.5) / (df + 0.5) + 1)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(lo, ROWS) for x in batches for lo in range(0, x.num_rows, ROWS)):
        counts = [Counter(_TERM.findall((t or "").translate(_FOLD))) for t in b.column("text").to_pylist()]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(c) for c in counts]))), pa.int32())
        terms, tfs = pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.total() for c in counts], pa.int32()), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)], names=["id", "length", "terms", "tfs"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings into blocks; `at` counts the term's postings before a block within the partition."""
    def blocks(rows: pa.Table, last: bool, seen: int) -> tuple[pa.RecordBatch, pa.Table, int]:
        n = rows.num_rows
        terms = rows.column("term").combine_chunks()
        codes = terms.dictionary_encode().indices.to_numpy() if n else np.zeros(0, np.int32)
        new = np.concatenate(([True], codes[1:] != codes[:-1])) if n else np.zeros(0, bool)
        run = np.flatnonzero(new)
        base = np.where(np.arange(len(run)) == 0, seen, 0) if len(run) else run
        which = np.cumsum(new) - 1
        place = np.arange(n) - run[which] + base[which] if n else np.arange(0)  # within the term
        start = np.flatnonzero(new | (place % BLOCK == 0))
        stop = np.append(start[1:], n) if n else start
        if not last and len(start):  # the last block may go on
            start, stop = start[:-1], stop[:-1]
        cut = int(stop[-1]) if len(stop) else 0
        w = rows.column("w").to_numpy()
        offsets = pa.array(np.append(start, cut), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks().slice(0, cut)) for c in ("id", "tf", "length")]
        batch = pa.RecordBatch.from_arrays([terms.take(pa.array(start)), pa.array(w[start]), pa.array(w[stop - 1]), pa.array(place[start]), pa.array((stop - start).astype(np.int32)), *lists], names=["term", "bound", "low", "at", "n", "ids", "tfs", "lengths"])
        rest = rows.slice(cut)
        return batch, rest, int(place[cut]) if cut < n else 0

    left, seen = None, 0
    for b in batches:
        rows = pa.Table.from_batches([b])
        out, left, seen = blocks(pa.concat_tables([left, rows]) if left is not None else rows, False, seen)
        if out.num_rows:
            yield out
    if left is not None and left.num_rows:
        yield blocks(left, True, seen)[0]


def build(docs: DataFrame) -> Postings:
    """Writes the index of docs (id, text) to the shared folder."""
    spark = docs.sparkSession
    forward = staged(spark, docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_forward, "id long, length int, terms array<string>, tfs array<int>"), "forward")
    stats = forward.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
    mean = stats["mean"] or 1.0
    each = forward.select("id", "length", F.posexplode("terms").alias("k", "term"), "tfs").select("term", "id", F.get("tfs", "k").alias("tf"), "length")
    each = each.withColumn("w", weight(F.col("tf"), F.col("length"), mean)).withColumn("back", -F.col("w"))
    made = each.repartitionByRange("term", "back").sortWithinPartitions("term", "back", "id").select("term", "id", "tf", "length", "w")
    blocks = staged(spark, made.mapInArrow(_packed, "term string, bound double, low double, at long, n int, ids array<long>, tfs array<int>, lengths array<int>"), "blocks")
    reached = [F.max(F.when(F.col("at") + F.col("n") >= k, F.col("low"))).alias(f"reach{k}") for k in LADDER]
    terms = staged(spark, blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("bound").alias("top"), *reached), "terms")
    return Postings(forward, blocks, terms, stats["docs"], mean)


def matched(index: Postings, asked: DataFrame, prefix: bool = True) -> DataFrame:
    """(query, token, term) of asked (query, token): terms that begin with the token, or equal it. Terms are cut to the lengths that tokens have, and joined on that."""
    own = asked.select("query", "token").where(F.length("token") > 0).distinct()
    if not prefix:
        return own.join(index.terms.select("term"), F.col("token") == F.col("term"))
    sizes = [r[0] for r in own.select(F.length("token").alias("n")).distinct().limit(256).collect()]
    if len(sizes) == 256:  # no real queries: every length from the shortest on
        heads = F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring("term", F.lit(1), n))
    else:
        heads = F.array_distinct(F.transform(F.filter(F.array(*(F.lit(n) for n in sorted(sizes))).cast("array<int>"), lambda n: n <= F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n)))
    return own.join(index.terms.select("term", F.explode(heads).alias("token")), "token").select("query", "token", "term")


def keyword_scores(index: Postings, asked: DataFrame, prefix: bool = True) -> DataFrame:
    """(query, id, score): how many of the query's tokens (query, token) begin a term of the document; documents with none are left out."""
    hits = matched(index, asked, prefix).join(index.blocks.select("term", "ids"), "term").select("query", "token", F.explode("ids").alias("id"))
    return hits.distinct().groupBy("query", "id").agg(F.count("*").cast("double").alias("score"))


def bm25(index: Postings, asked: DataFrame, limit: int) -> DataFrame:
    """(query, id, score): the `limit` best documents of each query (query, term) by BM25."""
    reach = next((F.col(f"reach{k}") for k in LADDER if k >= limit), F.lit(None).cast("double"))
    own = asked.select("query", "term").distinct().join(index.terms, "term").withColumn("idf", rarity(F.col("df"), index.docs))
    own = own.select("query", "term", "idf", (F.col("idf") * F.col("top")).alias("most"), (F.col("idf") * reach).alias("reach"))
    q, rising = Window.partitionBy("query"), Window.partitionBy("query").orderBy("most", "term")
    own = own.withColumn("sure", F.coalesce(F.max("reach").over(q), F.lit(0.0)) - 1e-9).withColumn("total", F.sum("most").over(q)).withColumn("weak", F.sum("most").over(rising) < F.col("sure"))
    own = staged(index.forward.sparkSession, own.drop("reach"), "asked")
    read = own.where(~F.col("weak")).join(index.blocks.select("term", "bound", "ids", "tfs", "lengths"), "term").where(F.col("idf") * F.col("bound") + F.col("total") - F.col("most") >= F.col("sure"))
    each = read.select("query", "idf", "most", "total", "sure", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
    found = each.groupBy("query", F.col("p.ids").alias("id")).agg(F.sum(F.col("idf") * weight(F.col("p.tfs"), F.col("p.lengths"), index.mean)).alias("part"), F.sum("most").alias("seen"), F.max("total").alias("total"), F.max("sure").alias("sure"))
    found = found.where(F.col("part") + F.col("total") - F.col("seen") >= F.col("sure")).select("query", "id")
    whole = own.groupBy("query").agg(F.collect_list(F.struct("term", "idf")).alias("asked"))  # a query's terms
    tf = lambda t: F.get("tfs", F.array_position("terms", t).cast("int") - 1)
    parts = F.transform("asked", lambda a: F.coalesce(a["idf"] * weight(tf(a["term"]), F.col("length"), index.mean), F.lit(0.0)))
    scored = found.join(whole, "query").join(index.forward, "id").select("query", "id", F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), 9).alias("score"))
    return scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= limit).drop("n")
