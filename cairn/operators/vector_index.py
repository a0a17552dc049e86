"""A written index of vectors by bands of their signatures, and nearest neighbours for a table of queries.

A vector's signature has 64 sign bits in four bands of 16. Two signatures within WITHIN bits differ in at most WITHIN // 4 bits in some band, so probing each band's bucket
and all buckets that many bit flips away meets every such pair: the index finds the whole candidate set, not a share of it. Equal vectors are one class, so
copies meet nobody twice; a pair counts in the first band only in which it is near enough.

A query is settled by its candidates if there are `limit` of them and the last of these has a cosine of `sure` or more: a vector that near is a candidate with a chance of 0.9.
All other queries, and those whose buckets hold more than DENSE of all classes, are asked of all classes in blocks (one scan, matrix products, the first of each task). Both ways give the
same rows, as the blocks tell candidates from others too. The queries of one scan are bounded in bytes (PASS_BYTES), sent to all tasks, and taken back before the next scan: the driver holds those of one scan alone.

Rows whose vector is null, of another length, of norm zero or not finite are in no class and neighbours of nothing. Ties go by id; each id should stand once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.sources.staging import staged

BANDS, BAND_BITS, WITHIN, DENSE = 4, 16, 12, 0.05
PASS_BYTES = 8 << 20
STEP = 256  # queries of one matrix product
FOUND = "query long, cls long, score double, near boolean"


def least_sure(within: int = WITHIN, chance: float = 0.9) -> float:
    """The least cosine at which signatures are within so many bits with this chance: each bit differs with the share of the angle in a half turn."""
    lo, hi = 0.0, 0.5
    for _ in range(60):
        p = (lo + hi) / 2
        met = sum(math.comb(V.BITS, k) * p**k * (1 - p) ** (V.BITS - k) for k in range(within + 1))
        lo, hi = (p, hi) if met >= chance else (lo, p)
    return round(math.cos(math.pi * lo), 6)


def flips(most: int) -> np.ndarray:
    """All values of a band with at most so many bits, fewest first."""
    values = np.arange(1 << BAND_BITS)
    bits = np.bitwise_count(values)
    return values[np.argsort(bits, kind="stable")][: int((bits <= most).sum())]


@dataclass
class VectorIndex:
    """rows (id, v) as given; classes (a, b, cls, v, n, sig): one row a distinct vector, (a, b) its key, cls its least id, n how many rows have it; buckets (band, bucket, cls, sig), sorted by bucket within files of a band; sizes, classes in each bucket."""

    rows: DataFrame
    classes: DataFrame
    buckets: DataFrame
    sizes: np.ndarray
    count: int
    copies: bool
    dims: int


def keyed(rows: DataFrame, dims: int) -> DataFrame:
    """rows (id, v) that have a direction, with `key`, 128 bits of the vector: equal vectors have equal keys."""
    v = F.transform(V.doubles(F.col("v")), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    n = V.norm(F.col("v"))
    good = rows.select(F.col("id").cast("long").alias("id"), v.alias("v")).where((F.size("v") == dims) & (n > 0) & ~F.isnan(n) & (n < float("inf")))
    return good.withColumn("key", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), F.col("v")).alias("b")))


def _signed(rows: DataFrame, dims: int) -> DataFrame:
    """rows (a, b, cls, v, n) with `sig`."""
    matrix = V.projection(dims).T

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            sig = ((x @ matrix >= 0).astype(np.uint64) << np.arange(V.BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("cls"), b.column("v"), b.column("n"), pa.array(sig.view(np.int64))], names=["a", "b", "cls", "v", "n", "sig"])

    return rows.select("a", "b", "cls", "v", "n").mapInArrow(sign, "a long, b long, cls long, v array<double>, n long, sig long")


def build(rows: DataFrame, dims: int) -> VectorIndex:
    """Writes classes and buckets of rows (id, v) to the shared folder. What comes to the driver is the table of bucket sizes, 2^18 numbers at most."""
    spark = rows.sparkSession
    one = keyed(rows, dims).groupBy("key").agg(F.min("id").alias("cls"), F.first("v").alias("v"), F.count("*").alias("n"))
    classes = staged(spark, _signed(one.select("key.a", "key.b", "cls", "v", "n"), dims), "classes")
    banded = classes.select(F.posexplode(F.array(*V.bands(F.col("sig")))).alias("band", "bucket"), "cls", "sig")
    buckets = staged(spark, banded.repartitionByRange("band", "bucket", "cls").sortWithinPartitions("band", "bucket", "cls"), "buckets")
    sizes = np.zeros((BANDS, 1 << BAND_BITS), dtype=np.int64)
    held = buckets.groupBy("band", "bucket").count().toArrow()
    sizes[held.column("band").to_numpy(), held.column("bucket").to_numpy()] = held.column("count").to_numpy()
    copies = not classes.where("n > 1").isEmpty()
    return VectorIndex(rows, classes, buckets, sizes, int(sizes[0].sum()), copies, dims)


def _probes(index: VectorIndex, asked: DataFrame, within: int, dense: float) -> DataFrame:
    """(query, sig, band, bucket) for buckets that hold something; one row without a band for a query whose buckets hold more than the dense share of all classes."""
    shared = index.classes.sparkSession.sparkContext.broadcast(index.sizes)
    masks, most = flips(within // BANDS), max(1.0, dense * index.count) * BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = shared.value
        for b in batches:
            query, sig = b.column("cls").to_numpy(), b.column("sig").to_numpy().view(np.uint64)
            at = np.stack([(sig >> np.uint64(BAND_BITS * k)) & np.uint64(0xFFFF) for k in range(BANDS)], axis=1).astype(np.int64)
            for lo in range(0, len(query), 256):
                bucket = at[lo : lo + 256, :, None] ^ masks[None, None, :]
                held = sizes[np.arange(BANDS)[None, :, None], bucket]
                full = held.sum(axis=(1, 2)) > most
                q, band, m = np.nonzero((held > 0) & ~full[:, None, None])
                whole = np.flatnonzero(full)
                q_all = np.concatenate((q, whole)) + lo
                none = np.concatenate((np.zeros(len(q), bool), np.ones(len(whole), bool)))
                band, value = np.concatenate((band, np.zeros(len(whole), np.int64))), np.concatenate((bucket[q, band, m], np.zeros(len(whole), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(query[q_all]), pa.array(sig[q_all].view(np.int64)), pa.array(band.astype(np.int32), mask=none), pa.array(value.astype(np.int32), mask=none)], names=["query", "sig", "band", "bucket"])

    return asked.select("cls", "sig").mapInArrow(run, "query long, sig long, band int, bucket int")


def candidates(index: VectorIndex, asked: DataFrame, within: int = WITHIN, dense: float = DENSE) -> DataFrame:
    """(query, cls, score): classes whose signatures are within so many bits of those of the asked classes, without those of dense queries. Buckets are joined by their number.

    Thousands of probes stand for one query, which the size that Spark estimates from the queries' files does not tell: without the hint the probes would be broadcast.
    """
    probe = _probes(index, asked, within, dense).where("band is not null").withColumnRenamed("sig", "q_sig")
    met = probe.hint("merge").join(index.buckets, ["band", "bucket"]).where(F.bit_count(F.col("q_sig").bitwiseXOR(F.col("sig"))) <= within)
    off = [F.bit_count(a.bitwiseXOR(b)) > within // BANDS for a, b in zip(V.bands(F.col("q_sig")), V.bands(F.col("sig")), strict=True)]
    first = F.lit(True)
    for k in range(BANDS - 1):
        first = first & ((F.col("band") <= k) | off[k])
    met = met.where(first).select("query", "cls").join(index.classes.select("cls", "v"), "cls")
    return met.join(asked.select(F.col("cls").alias("query"), F.col("v").alias("q_v")), "query").select("query", "cls", V.cosine(F.col("q_v"), F.col("v")).alias("score")).where("score > 0")


def in_blocks(index: VectorIndex, asked: DataFrame, limit: int, within: int = WITHIN) -> DataFrame:
    """(query, cls, score, near): the first `limit` of all classes for each asked class, and the first of those within so many bits, from scans with a bounded number of queries each."""
    spark = asked.sparkSession
    n, most = asked.count(), max(1, PASS_BYTES // (index.dims * 8))
    pieces = 1 if n <= most else 2 * -(-n // most)  # a hash deals half of PASS_BYTES to each
    w, out = Window.partitionBy("query", "near").orderBy(F.desc("score"), "cls"), spark.createDataFrame([], FOUND)
    for k in range(pieces if n else 0):
        found, shared = _scan(spark, index, asked.where(F.pmod(F.xxhash64("cls"), F.lit(pieces)) == k).select("cls", "v", "sig").toArrow(), limit, within)
        out = out.unionByName(staged(spark, found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n"), "scanned"))
        shared.destroy()
    return out


def _first(score: np.ndarray, cls: np.ndarray, limit: int) -> np.ndarray:
    """Columns of the `limit` highest scores of each row, ties by cls; score may have more columns than limit."""
    if score.shape[1] > 4 * limit:  # all that may be among the first, then in order
        bar = -np.partition(-score, limit - 1, axis=1)[:, limit - 1 : limit]
        most = int((score >= bar).sum(axis=1).max())
        near = np.argpartition(-score, min(most, score.shape[1] - 1), axis=1)[:, :most]
        order = np.lexsort((cls[near], -np.take_along_axis(score, near, 1)), axis=1)[:, :limit]
        return np.take_along_axis(near, order, 1)
    return np.lexsort((np.broadcast_to(cls, score.shape), -score), axis=1)[:, :limit]


def _scan(spark: SparkSession, index: VectorIndex, block: pa.Table, limit: int, within: int) -> tuple[DataFrame, Broadcast]:
    """Each task's first, and what was sent to the tasks."""
    dims = index.dims
    q = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    shared = spark.sparkContext.broadcast((block.column("cls").to_numpy(), q / np.linalg.norm(q, axis=1, keepdims=True), block.column("sig").to_numpy().view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, asked, signs = shared.value
        best = {near: (np.zeros((len(query), limit)), np.zeros((len(query), limit), np.int64)) for near in (False, True)}
        for b in batches:
            cls, sig = b.column("cls").to_numpy(), b.column("sig").to_numpy().view(np.uint64)
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for lo in range(0, len(query), STEP):
                part = slice(lo, lo + STEP)
                every = (asked[part] @ x.T).clip(0, 1)
                close = np.bitwise_count(signs[part, None] ^ sig[None, :]) <= within
                for near, (score, held) in best.items():
                    now = np.where(close, every, 0.0) if near else every
                    cut = _first(now, cls, limit)
                    scores, ids = np.concatenate((score[part], np.take_along_axis(now, cut, 1)), axis=1), np.concatenate((held[part], cls[cut]), axis=1)
                    order = np.lexsort((ids, -scores), axis=1)[:, :limit]
                    score[part], held[part] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        for near, (score, held) in best.items():
            ok = score > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, ok.sum(1))), pa.array(held[ok]), pa.array(score[ok]), pa.array(np.full(int(ok.sum()), near))], names=["query", "cls", "score", "near"])

    return index.classes.select("cls", "v", "sig").mapInArrow(run, FOUND), shared


def nearest(index: VectorIndex, asked: DataFrame, limit: int, within: int = WITHIN, sure: float | None = None, dense: float = DENSE) -> DataFrame:
    """(query, id, score): for each asked row (id, v), in the index or not, the `limit` rows of highest positive cosine among its candidates where these settle it, else among all."""
    spark, bar = asked.sparkSession, least_sure(within) if sure is None else sure
    own = keyed(asked, index.dims).select("key.a", "key.b", F.col("id").alias("cls"), "v", F.lit(1).cast("long").alias("n"))
    own = staged(spark, _signed(own, index.dims), "asked")
    first = own.groupBy("a", "b").agg(F.min("cls").alias("query"), F.count("*").alias("n"))
    copies = index.copies or not first.where("n > 1").isEmpty()
    ask = own.join(first.select(F.col("query").alias("cls")), "cls", "left_semi") if copies else own
    w = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    found = staged(spark, candidates(index, ask, within, dense).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit), "found")
    settled = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("last")).where((F.col("n") >= limit) & (F.col("last") >= bar)).select("query")
    rest = in_blocks(index, ask.join(settled, ask["cls"] == settled["query"], "left_anti"), limit, within)
    each = Window.partitionBy("query")
    rest = rest.withColumn("settled", (F.count_if("near").over(each) >= limit) & (F.min(F.when(F.col("near"), F.col("score"))).over(each) >= bar))
    rest = rest.where(F.col("near") == F.col("settled")).select("query", "cls", "score")
    best = found.join(settled, "query", "left_semi").select("query", "cls", "score").unionByName(rest)
    if not copies:
        return best.select("query", F.col("cls").alias("id"), "score")
    member = keyed(index.rows, index.dims).select("id", "key.a", "key.b").withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("n") <= limit)
    member = member.join(index.classes.select("a", "b", "cls"), ["a", "b"]).select("cls", "id")
    names = own.select("a", "b", F.col("cls").alias("asked")).join(first.select("a", "b", "query"), ["a", "b"]).select("query", "asked")
    out = best.join(names, "query").join(member, "cls")
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))).where(F.col("n") <= limit)
    return out.select(F.col("asked").alias("query"), "id", "score")
