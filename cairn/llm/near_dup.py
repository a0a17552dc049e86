"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its distinct 2-word shingles; equal sets are one class, with its least doc_id for a representative.
A class has `CHUNKS * SIZE` MinHash symbols of `BITS` bits, split into chunks; `ERRORS` of a chunk's symbols may differ, and
each way of leaving them out is a key. By the pigeonhole principle any two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 = 15 of 40 symbols share a key; two sets of similarity 0.8 share none with a chance of 2.3e-5.

Classes that share a key are not all paired. Each key has a hub, the class that meets most others; members are confirmed
against their hub on full sets and joined into components. What is left (members of one hub in different components) is
compared block against block, and only where the triangle inequality of the Jaccard distance allows a link: distances to a hub that
differ by more than 0.2 rule it out exactly. No cap stands anywhere; copies cost one row each, and of pairs only links are emitted.

Texts that are null or without words have an empty set and link with nothing; so do rows with a null doc_id (their component is
null and they are kept). Rows of one doc_id are one node. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import staged, table
from cairn.llm.components import components
from cairn.llm.decontaminate import _maybe, bloom

CHUNKS, SIZE, ERRORS, BITS = 8, 5, 1, 16
LEAST = 4  # a set of fewer shingles reaches 0.8 with its equal only
_XOR = T.mix(np.arange(1, CHUNKS * SIZE + 1, dtype=np.uint64) * np.uint64(77))
_MUL = T.mix(np.arange(1, CHUNKS * SIZE + 1, dtype=np.uint64) * np.uint64(1013)) | np.uint64(1)


def _sets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, shingles, bounds): each document's distinct shingle hashes, rising."""
    for lo, hi, buf, starts in T.blocks(col):
        low = T.LOWER[buf]
        s, e = T.spans(T.GRAPHIC[low])
        doc = T.owner(starts, s)
        h = T.hash_spans(low, s, e)
        n = T.count_by(doc, hi - lo)
        pair = T.mix(h[:-1] + T.mix(h[1:] + np.uint64(1))) if len(h) > 1 else h[:0]
        own = np.flatnonzero(doc[:-1] == doc[1:])
        single = np.flatnonzero(n[doc] == 1)
        sh, at = np.concatenate((pair[own], T.mix(h[single] + np.uint64(5)))), np.concatenate((doc[own], doc[single]))
        if len(single):
            order = np.argsort(at, kind="stable")
            sh, at = sh[order], at[order]
        edge = np.searchsorted(at, np.arange(hi - lo + 1))
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            sh[a:z].sort()
        first = np.ones(len(sh), bool)
        first[1:] = (sh[1:] != sh[:-1]) | (at[1:] != at[:-1])
        yield lo, hi, sh[first], np.searchsorted(at[first], np.arange(hi - lo + 1))


def _sums(sh: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each whole set."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        total = np.zeros(len(sh) + 1, np.uint64)
        np.cumsum(T.mix(sh ^ np.uint64(salt)), out=total[1:])
        out.append(total[edge[1:]] - total[edge[:-1]])
    return out[0], out[1]


def _symbols(sh: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """MinHash symbols of each (non-empty) set."""
    out = np.zeros((len(edge) - 1, CHUNKS * SIZE), np.uint64)
    for j in range(CHUNKS * SIZE):
        least = np.minimum.reduceat((sh ^ _XOR[j]) * _MUL[j], edge[:-1])
        out[:, j] = T.mix(least) >> np.uint64(64 - BITS)
    return out


def _keys(symbols: np.ndarray) -> np.ndarray:
    """One key for each chunk and each symbol left out of it."""
    keys = []
    for c in range(CHUNKS):
        part = symbols[:, c * SIZE : (c + 1) * SIZE]
        for left_out in range(SIZE):
            k = np.full(len(part), c * SIZE + left_out + 1, np.uint64)
            for j in range(SIZE):
                if j != left_out:
                    k = T.mix(k * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
            keys.append(k)
    return np.stack(keys, 1) if len(symbols) else np.zeros((0, CHUNKS * SIZE), np.uint64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, s1, s2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
        keyed, keys = np.zeros(b.num_rows, np.int64), []
        for lo, hi, sh, edge in _sets(b.column("text")):
            n[lo:hi] = np.diff(edge)
            s1[lo:hi], s2[lo:hi] = _sums(sh, edge)
            enough = np.flatnonzero(n[lo:hi] >= LEAST)
            if len(enough):
                own = np.repeat(n[lo:hi] >= LEAST, n[lo:hi])
                cut = np.concatenate(([0], np.cumsum(n[lo:hi][enough])))
                keys.append(_keys(_symbols(sh[own], cut)))
                keyed[lo:hi][enough] = CHUNKS * SIZE
        flat = np.concatenate(keys).ravel().view(np.int64) if keys else np.zeros(0, np.int64)
        per = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(keyed))).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), per], names=["row", "doc_id", "n_shingles", "s1", "s2", "keys"])


def scan(docs: DataFrame, key: str | None = None) -> DataFrame:
    row = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, "row long, doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def _marked(s1: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return T.mix(s1 ^ T.mix(doc_id.view(np.uint64)))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of wanted classes (rep, s1, s2), from their representatives' texts. A Bloom filter of fixed size keeps other
    texts out of the shuffle; the join settles it."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _marked(b.column("s1").to_numpy().view(np.uint64), b.column("rep").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])

    filter_bits = 26
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select("rep", "s1").mapInArrow(mark, "fp long"), filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, hi, sh, edge in _sets(b.column("text")):
                s1, s2 = _sums(sh, edge)
                ok = np.flatnonzero(_maybe(shared.value, _marked(s1, ids[lo:hi]), filter_bits) & (np.diff(edge) >= LEAST))
                if len(ok):
                    take = np.zeros(hi - lo, bool)
                    take[ok] = True
                    part = sh[np.repeat(take, np.diff(edge))]
                    offs = np.concatenate(([0], np.cumsum(np.diff(edge)[ok])))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][ok]), pa.array(s1[ok].view(np.int64)), pa.array(s2[ok].view(np.int64)), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(part.view(np.int64)))], names=["rep", "s1", "s2", "shingles"])

    found = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "rep long, s1 long, s2 long, shingles array<long>")
    return found.join(wanted.select("rep", "s1", "s2"), ["rep", "s1", "s2"], "left_semi").dropDuplicates(["rep"]).select("rep", "shingles")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = np.zeros(b.num_rows, np.int64)
        x, y = (b.column(c) for c in ("x", "y"))
        xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
        nx, ny = np.diff(xo), np.diff(yo)
        for i in range(b.num_rows):
            two = np.concatenate((xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]))
            two.sort()
            both[i] = np.count_nonzero(two[1:] == two[:-1])
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(both), pa.array(nx + ny - both)], names=["a", "b", "i", "u"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, i, u): sizes of intersection and union of pairs on full sets."""
    left = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return left.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(_overlap, "a long, b long, i long, u long")


def near_duplicates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles, component_id, kept; and where one is named the column `key` of numbers, with `text_class`, equal for equal sets of shingles."""
    spark = docs.sparkSession
    scanned = staged(spark, scan(docs, key), "scanned")
    real = scanned.where("n_shingles > 0 and doc_id is not null")
    classes = staged(spark, real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    keyed = classes.where(F.col("n") >= LEAST).select("rep", F.explode("keys").alias("key"))
    met = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    met = staged(spark, met, "met")
    rank = met.groupBy("rep").agg(F.sum("size").alias("rank"))
    hubs = met.join(rank, "rep").groupBy("key").agg(F.max(F.struct("rank", (-F.col("rep")).alias("m"))).alias("h")).select("key", (-F.col("h.m")).alias("hub"))
    members = staged(spark, met.join(hubs, "key").select("key", "hub", "rep"), "members")
    sets = staged(spark, full_sets(docs, classes.join(met.select("rep").distinct(), "rep", "left_semi")), "sets")
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = staged(spark, confirm(stars, sets), "stars")
    link = "100 * i >= 80 * u"
    comp = components(stars.where(link))
    more = staged(spark, links_left(classes, stars, comp, sets), "more")
    if not more.isEmpty():
        comp = components(stars.where(link).select("a", "b").unionByName(more))
    named = classes.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    rows = scanned.select("row", "doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("s1")).alias("s1"), "s2")
    found = rows.join(named, ["s1", "s2"], "left").withColumn("component_id", F.coalesce("comp", "doc_id"))
    named = [F.col("row").alias(key), F.col("s1").alias("text_class")] if key else []
    return found.select(*named, "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _block(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rep, comp, sizes and shingles of the members in one row."""
    rep, comp, sets = column[i].values.flatten()
    return rep.to_numpy(), comp.to_numpy(), np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy()


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of sets, members of one component aside: counts of common shingles as one matrix product."""
    for batch in batches:
        for r in range(batch.num_rows):
            (rx, cx, nx, vx), (ry, cy, ny, vy) = _block(batch.column("x"), r), _block(batch.column("y"), r)
            if len(np.unique(np.concatenate((cx, cy)))) < 2:
                continue
            words, inv = np.unique(np.concatenate((vx, vy)), return_inverse=True)
            common = np.zeros((len(rx), len(ry)), np.float32)
            own = np.repeat(np.arange(len(rx) + len(ry)), np.concatenate((nx, ny)))
            for lo in range(0, len(words), PANEL):  # a panel of shingles at a time: memory stays bounded
                part = (inv >= lo) & (inv < lo + PANEL)
                m = np.zeros((len(rx) + len(ry), min(PANEL, len(words) - lo)), np.float32)
                m[own[part], inv[part] - lo] = 1
                common += m[: len(rx)] @ m[len(rx) :].T
            common = common.astype(np.int64)
            i, j = np.nonzero((100 * common >= 80 * (nx[:, None] + ny[None, :] - common)) & (cx[:, None] != cy[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(rx[i]), pa.array(ry[j])], names=["a", "b"])


PANEL = 4096
BLOCK = 60_000  # shingles, and MEMBER more for each member
MEMBER = 60


def links_left(classes: DataFrame, stars: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of members of one hub that are not of one component. Members are dealt to blocks of bounded size by their distance
    to the hub, and only blocks whose distances can be within 0.2 of each other meet; no pairs are emitted but links. Members are
    dealt as ids, and sets meet them by id, so that no task gathers a large hub's sets."""
    spark = classes.sparkSession
    known = stars.select(F.col("a").alias("hub"), F.col("b").alias("rep"), (1 - F.col("i") / F.col("u")).alias("d"))
    known = known.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    known = staged(spark, known.join(classes.select("rep", (F.col("n") + MEMBER).alias("weight")), "rep"), "known")
    hubs = known.groupBy("hub").agg(F.max("d").alias("far"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum("weight").alias("all"))
    hubs = staged(spark, hubs.where("far > 0.2 and c0 <> c1").select("hub", "all"), "hubs")
    side = known.join(hubs, "hub").withColumn("bin", F.when(F.col("all") <= BLOCK, 0).otherwise(1 + F.least(F.floor(F.col("d") * 5 + 1e-9), F.lit(4))))
    side = staged(spark, side.drop("all"), "side")
    sizes = staged(spark, side.groupBy("hub", "bin").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks")), "sizes")
    dealt = side.join(sizes, ["hub", "bin"]).select("hub", "bin", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "rep", "comp")
    blocks = dealt.join(sets, "rep").groupBy("hub", "bin", "block").agg(F.collect_list(F.struct("rep", "comp", "shingles")).alias("m"))  # bounded by BLOCK
    blocks = staged(spark, blocks, "blocks")
    mine = blocks.select("hub", "bin", "block")
    other = mine.select("hub", F.col("bin").alias("bin2"), F.col("block").alias("block2"))
    meet = mine.join(other, "hub").where("bin2 - bin in (0, 1) and (bin2 > bin or block2 >= block) and not (bin = 1 and bin2 = 1)")
    first = meet.join(blocks.withColumnRenamed("m", "x"), ["hub", "bin", "block"])
    both = first.join(blocks.select("hub", F.col("bin").alias("bin2"), F.col("block").alias("block2"), F.col("m").alias("y")), ["hub", "bin2", "block2"])
    return both.select("x", "y").mapInArrow(_between, "a long, b long").distinct()


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_near_dup": op8_near_dup}
#: all pairs by their common shingles, and components by labels handed on along the links
ORACLE_SQL = {
    "op8_near_dup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(generate_series(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1]) end) as s from d),
c as (select s, min(doc_id) as rep, len(s) as n from (select doc_id, list_sort(s) as s from s where doc_id is not null and len(s) > 0) group by s),
x as (select rep, n, hash(unnest(s)) as h from c),
p as (select a.rep as a, b.rep as b, a.n as an, b.n as bn, count(*) as i from x a join x b on a.h = b.h and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
e as (select a, b from p where 100 * i >= 80 * (an + bn - i)),
e2 as (select a, b from e union all select b, a from e),
reach as (select rep as node, rep as root from c union select e2.b, reach.root from reach join e2 on e2.a = reach.node where reach.root < e2.b),
l as (select node, min(root) as root from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(l.root, s.doc_id) as component_id, s.doc_id is not distinct from coalesce(l.root, s.doc_id) as kept
from s left join (select list_sort(s) as k, rep from (select s, rep from c)) as k on list_sort(s.s) = k.k and s.doc_id is not null left join l on l.node = k.rep"""
}
