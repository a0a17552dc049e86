"""Language-model scoring by context-tree weighting, beside a unigram base score.

Bytes of the lower-cased text, ended by 0xFF (which no UTF-8 text holds), are coded bit by bit; each byte context of
0 to `depth` bytes keeps zero and one counts for the 255 inner nodes of the byte's bits, Krichevsky-Trofimov estimates
are mixed over all depths by their context-tree weights, and a text's score is its log10 probability under the frozen tree.

Counts come from every training text (outside the held-out fold), and every counted context is a node of the tree. Contexts of up to
`TOP` bytes, which the alphabet bounds, stand in one place; each longer context belongs to the subtree of its last TOP + 1 bytes, and subtrees
are weighed apart, in tasks, from the counted strings. `frequent` strings at most are looked up in the scan; all others, the unseen ones
with them, are weighed in their subtrees and joined, so no string's score hangs on which way it took.

Base score: tokens are counted in Spark; tokens holding at least one in `frequent` of all (so at most `frequent` of them)
are looked up in the scan, the others by a shuffled join, so the vocabulary never passes through one place.

Null and empty texts are the end token and the end byte alone. Rows are scored one by one and equal rows get equal scores;
a null doc_id counts as training; other columns are ignored; with no training text N and V are 0 and every bit costs one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import fold_is, staged, table

DEPTH = 5
TOP = 2
END = 255
TOKEN, GRAM = 0, 1
#: strings that a task weighs at once, in whole subtrees
WEIGHED = 1 << 18


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


def _lowered(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    low = T.LOWER[buf]
    low[starts[1:] - 1] = END
    return low


def _tokens(low: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and their documents."""
    inside = T.GRAPHIC[low]
    inside[starts[1:] - 1] = False
    s, e = T.spans(inside)
    return T.hash_spans(low, s, e), T.owner(starts, s)


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {TOKEN: [], GRAM: []}

    def emit(kind: int) -> pa.RecordBatch:
        k, c = _summed([x for x, _ in held[kind]], [x for _, x in held[kind]])
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], names=["kind", "key", "c"])

    for b in batches:
        for _, _, buf, starts in T.blocks(b.column("text")):
            low = _lowered(buf, starts)
            h, _ = _tokens(low, starts)
            for kind, keys in ((TOKEN, h), (GRAM, T.grams(low, starts, depth + 1, END))):
                if len(keys):
                    held[kind].append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[kind]) > 2_000_000:
                    k, c = _summed([x for x, _ in held[kind]], [x for _, x in held[kind]])
                    held[kind] = [(k, c)]
                    if len(k) > 1_000_000:  # what one task holds stays bounded; Spark adds the parts up
                        yield emit(kind)
    for kind in held:
        if held[kind]:
            yield emit(kind)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive x: Stirling's series after shifting small arguments up by eight."""
    shift = np.zeros_like(x)
    small = x < 8
    y = np.where(small, x + 8, x)
    for k in range(8):
        shift += np.where(small, np.log(x + k), 0.0)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 inner nodes of the byte's bits, heap order."""
    pairs = [counts.reshape(len(counts), 1 << bit, 2, 128 >> bit).sum(-1) for bit in range(8)]
    both = np.concatenate(pairs, axis=1)
    return both[..., 0], both[..., 1]


def _kt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log evidence and probability of a one at each node."""
    return _kt_of(*_nodes(counts))


def _kt_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi), (b + 0.5) / (a + b + 1)


class Tree:
    """Log10 probability of each byte in each context; `keys[d]` are the contexts of d bytes, in order. `below` is the summed log weight of
    the subtrees under each node of the deepest contexts, where there are such; `often` are strings and their log10 probabilities."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], below: np.ndarray | None = None):
        self.depth = len(levels) - 1
        self.height = self.depth
        self.often = np.zeros(0, np.uint64), np.zeros(0)
        self.keys = [k for k, _ in levels]
        logw: list = [None] * (self.depth + 1)
        rest_p: list = [None] * (self.depth + 1)
        weight: list = [None] * (self.depth + 1)
        prob: list = [None] * (self.depth + 1)
        parent: list = [None] * (self.depth + 1)
        for d in range(self.depth, -1, -1):
            evidence, prob[d] = _kt(levels[d][1])
            if d == self.depth:
                if below is None:
                    logw[d], weight[d], rest_p[d] = evidence, np.ones_like(evidence), prob[d]
                else:
                    logw[d] = np.logaddexp(evidence, below) + np.log(0.5)
                    weight[d], rest_p[d] = np.exp(np.log(0.5) + evidence - logw[d]), np.full_like(evidence, 0.5)
                continue
            parent[d + 1] = np.searchsorted(self.keys[d], T.tail(self.keys[d + 1], d) if d else np.zeros(len(self.keys[d + 1]), np.uint64))
            rest = levels[d][1].astype(np.float64)
            np.subtract.at(rest, parent[d + 1], levels[d + 1][1])
            rest_evidence, rest_p[d] = _kt(rest)
            split = rest_evidence
            np.add.at(split, parent[d + 1], logw[d + 1])
            logw[d] = np.logaddexp(evidence, split) + np.log(0.5)
            weight[d] = np.exp(np.log(0.5) + evidence - logw[d])
        rows, mixed, left = [], np.zeros((1, 255)), np.ones((1, 255))
        for d in range(self.depth + 1):
            if d:
                mixed, left = mixed[parent[d]], left[parent[d]]
            mixed = mixed + left * weight[d] * prob[d]
            left = left * (1 - weight[d])
            rows.append((mixed, left, rest_p[d]))
        self.start = np.cumsum([0, *(len(r[0]) for r in rows)])
        self.mixed, self.left, self.rest = (np.concatenate(x) for x in zip(*rows, strict=True))

    @cached_property
    def table(self) -> np.ndarray:
        return _bytes(self.mixed + self.left * self.rest).astype(np.float32)

    def probes(self) -> list[T.Probe]:
        return [T.Probe(k) for k in self.keys]

    def rows(self, key: np.ndarray, probes: list[T.Probe]) -> np.ndarray:
        """The longest context here of each packed string's last byte."""
        ctx, row, left = key >> np.uint64(8), np.zeros(len(key), np.int64), None
        for d in range(self.depth, 0, -1):
            got = probes[d].find(T.tail(ctx if left is None else ctx[left], d))
            hit = got >= 0
            if left is None:
                row[hit] = got[hit] + self.start[d]
                left = np.flatnonzero(~hit)
            else:
                row[left[hit]] = got[hit] + self.start[d]
                left = left[~hit]
        return row

    def bits(self, key: np.ndarray, probes: list[T.Probe]) -> np.ndarray:
        """Log10 probability of the last byte of each packed string after the others."""
        return self.table.ravel()[self.rows(key, probes) * 256 + (key & np.uint64(255)).astype(np.int64)]

    def finish(self, key: np.ndarray, q: np.ndarray, probes: list[T.Probe]) -> np.ndarray:
        """Log10 probability of each string's last byte, from its subtree's probabilities of a one."""
        row, byte, out = self.rows(key, probes), (key & np.uint64(255)).astype(np.int64), np.zeros(len(key))
        for bit in range(8):
            node = (1 << bit) - 1 + (byte >> (8 - bit))
            one = np.clip(self.mixed[row, node] + self.left[row, node] * q[:, bit], 1e-12, 1 - 1e-12)
            out += np.log10(np.where((byte >> (7 - bit)) & 1, one, 1 - one))
        return out


def _bytes(one: np.ndarray) -> np.ndarray:
    """Log10 probability of the 256 bytes from the probability of a one at each node."""
    byte, out = np.arange(256), np.zeros((len(one), 256))
    one = np.clip(one, 1e-12, 1 - 1e-12)
    for bit in range(8):
        node = (1 << bit) - 1 + (byte >> (8 - bit))
        out += np.where((byte >> (7 - bit)) & 1, np.log10(one)[:, node], np.log10(1 - one)[:, node])
    return out


def held(doc_id: Column) -> Column:
    return fold_is(doc_id, 7, 2)


def count(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, c): tokens by hash and packed strings of depth + 1 bytes, over all texts of docs."""
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(lambda it: _count(it, depth), "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def weigh(key: np.ndarray, c: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole subtrees, as distinct strings and their counts: the nodes above (context of TOP bytes, node) with the log weights below
    them, then the strings in order and their probabilities of a one at each bit, mixed over the depths below TOP."""
    order = np.argsort(key)
    chain = [(key[order], c[order].astype(float), None)]
    for d in range(depth - 1, TOP, -1):
        s, up = np.unique(T.tail(chain[-1][0], d + 1), return_inverse=True)
        chain.append((s, np.bincount(up, chain[-1][1], len(s)), up))
    q, nodes, weights = np.empty((len(key), 8)), [], []
    for bit in range(8):
        row, logw, first, one = np.arange(len(key)), None, None, None
        for s, n, up in chain:  # symbols of a context stand together, in the order of their bytes
            head = s >> np.uint64(8 - bit)
            new = np.concatenate(([True], head[1:] != head[:-1]))
            g = np.cumsum(new) - 1
            total, ones = np.bincount(g, n), np.bincount(g, n * ((s >> np.uint64(7 - bit)) & np.uint64(1)))
            evidence, p = _kt_of(total - ones, ones)
            if up is None:
                logw, one = evidence, p[g]
            else:
                split = np.bincount(g[up[first]], logw, len(p))
                logw = np.logaddexp(evidence, split) + np.log(0.5)
                w = np.exp(np.log(0.5) + evidence - logw)
                row = up[row]
                at = g[row]
                one = w[at] * p[at] + (1 - w[at]) * one
            first = np.flatnonzero(new)
        q[:, bit] = one
        s = s[first]
        node = np.uint64((1 << bit) - 1) + ((s & np.uint64(255)) >> np.uint64(8 - bit))
        nodes.append(T.tail(s >> np.uint64(8), TOP) << np.uint64(8) | node)
        weights.append(logw)
    return *_summed(nodes, weights), chain[0][0], q


def _weighed(strings: DataFrame, each) -> tuple:
    """Rows (key, c, asked) dealt by subtree, and the function for mapInArrow that passes whole subtrees to `each`, which makes a record batch of key, c and asked."""
    root = F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * (TOP + 1))) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            parts.append(tuple(b.column(x).to_numpy(zero_copy_only=False) for x in ("key", "c", "asked")))
            if sum(len(x[0]) for x in parts) >= WEIGHED:
                key, c, asked = (np.concatenate(x) for x in zip(*parts, strict=True))
                of = T.tail(key.view(np.uint64) >> np.uint64(8), TOP + 1)
                cut = int(np.flatnonzero(of == of[-1])[0])  # the last subtree may go on
                if cut:
                    yield each(key[:cut].view(np.uint64), c[:cut], asked[:cut])
                parts = [(key[cut:], c[cut:], asked[cut:])]
        key, c, asked = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        if len(key):
            yield each(key.view(np.uint64), c, asked)

    return strings.select("key", "c", "asked").withColumn("root", root).repartition("root").sortWithinPartitions("root").drop("root"), run


def tree(counts: DataFrame, depth: int = DEPTH, frequent: int = 1 << 19) -> Tree:
    """The weighted tree from counted strings: its contexts of up to TOP bytes, and the probabilities of the `frequent` commonest strings at most."""
    spark = counts.sparkSession
    grams = counts.where(F.col("kind") == GRAM).select("key", "c")
    size = F.floor(F.log2("c") * 4)
    most, least = 0, 1 << 30
    for r in sorted(grams.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["size"]):
        most += r["n"]
        if most > frequent:
            break
        least = r["size"]

    def weighed(key: np.ndarray, c: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        node, logw, string, q = weigh(key, c, depth)
        asked = asked[np.argsort(key)]
        string, q = string[asked], q[asked]
        ones = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(len(node) + 1, np.int32), np.arange(8, 8 * len(string) + 1, 8, dtype=np.int32)))), pa.array(q.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([True, False], [len(node), len(string)])), pa.array(np.concatenate((node, string)).view(np.int64)), pa.array(np.concatenate((logw, np.zeros(len(string))))), ones], names=["above", "key", "logw", "ones"])

    dealt, run = _weighed(grams.withColumn("asked", size >= least), weighed)
    parts = staged(spark, dealt.mapInArrow(run, "above boolean, key long, logw double, ones array<double>"), "subtrees")
    ctx = lambda d: F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * d)) - 1)
    each = grams.groupBy(F.col("key").bitwiseAND((1 << (8 * (TOP + 1))) - 1).alias("key")).agg(F.sum("c").alias("c"))
    got = each.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), ctx(d).alias("ctx")) for d in range(TOP + 1)))).alias("x"), F.col("key").bitwiseAND(255).alias("byte"), "c").groupBy("x.d", "x.ctx", "byte").agg(F.sum("c").alias("c")).toArrow()
    d, key, byte, c = (got.column(x).to_numpy() for x in ("d", "ctx", "byte", "c"))
    levels = []
    for k in range(TOP + 1):
        own = d == k
        keys, inv = np.unique(key[own].view(np.uint64), return_inverse=True)
        table_ = np.zeros((len(keys), 256))
        table_[inv, byte[own]] = c[own]
        levels.append((keys, table_) if k or len(keys) else (np.zeros(1, np.uint64), np.zeros((1, 256))))
    sums = parts.where("above").groupBy("key").agg(F.sum("logw").alias("logw")).toArrow()  # at most 255 for each context of TOP bytes
    at = sums.column("key").to_numpy().view(np.uint64)
    below = np.zeros((len(levels[TOP][0]), 255))
    below[np.searchsorted(levels[TOP][0], at >> np.uint64(8)), (at & np.uint64(255)).astype(np.int64)] = sums.column("logw").to_numpy()
    model = Tree(levels, below)
    model.height = depth
    shared = spark.sparkContext.broadcast(model)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        probes = m.probes()
        for b in batches:
            q = b.column("ones").flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(m.finish(b.column("key").to_numpy().view(np.uint64), q, probes))], names=["key", "p"])

    often = parts.where("not above").select("key", "ones").mapInArrow(finished, "key long, p double").toArrow()  # at most `frequent` rows
    model.often = often.column("key").to_numpy().view(np.uint64), often.column("p").to_numpy()
    return model


def score(docs: DataFrame, counts: DataFrame, model: Tree, train_docs: int, frequent: int = 1 << 19) -> DataFrame:
    """Scores of docs (doc_id, held_out, text); counts is a written table."""
    spark = docs.sparkSession
    tokens = counts.where(F.col("kind") == TOKEN).select(F.col("key").alias("h"), "c")
    got = tokens.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n, v = (got["n"] or 0) + train_docs, got["v"] + (train_docs > 0)
    often = tokens.where(F.col("c") * frequent >= n).toArrow()  # at most `frequent` rows
    keys, logs = often.column("h").to_numpy().view(np.uint64), np.log10(often.column("c").to_numpy() + 1.0)
    shared = spark.sparkContext.broadcast((model.often, keys, logs))
    depth = model.height
    end, unit = float(np.log10(train_docs + 1.0)), float(np.log10(n + v + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (strings, p), k, lg = shared.value
        seen, find = T.Probe(strings), T.Probe(k)
        for b in batches:
            total, known, base, logp = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)
            rare: dict[int, tuple[list, list]] = {kind: ([np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]) for kind in (TOKEN, GRAM)}
            for lo, hi, buf, starts in T.blocks(b.column("text")):
                low = _lowered(buf, starts)
                h, doc = _tokens(low, starts)
                row = find.find(h)
                hit = row >= 0
                total[lo:hi] = T.count_by(doc, hi - lo) + 1
                known[lo:hi] = T.count_by(doc[hit], hi - lo) + (train_docs > 0)
                base[lo:hi] = T.count_by(doc[hit], hi - lo, lg[row[hit]]) + end
                string = T.grams(low, starts, depth + 1, END)
                at = seen.find(string)
                near = at >= 0
                value = np.zeros(len(string))
                value[near] = p[at[near]]
                logp[lo:hi] = np.add.reduceat(value, starts[:-1])
                far = np.flatnonzero(~near)
                for kind, keys, of in ((TOKEN, h[~hit], doc[~hit]), (GRAM, string[far], T.owner(starts, far))):
                    rare[kind][0].append(keys)
                    rare[kind][1].append(T.count_by(of, hi - lo))
            lists = [pa.LargeListArray.from_arrays(pa.array(np.cumsum(np.concatenate(n))), pa.array(np.concatenate(k_).view(np.int64))).cast(pa.list_(pa.int64())) for k_, n in rare.values()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *map(pa.array, (total, known, base, logp)), *lists], names=["doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare", "strings"])

    scanned = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<long>, strings array<long>").withColumn("row", F.monotonically_increasing_id())
    scanned = staged(spark, scanned, "scanned")
    met = scanned.select("row", F.explode("rare").alias("h")).join(tokens, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    far = scanned.select("row", F.explode("strings").alias("key"))
    below = far.select("key", F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")).distinct().unionByName(counts.where(F.col("kind") == GRAM).select("key", "c", F.lit(False).alias("asked")))
    tops = spark.sparkContext.broadcast(model)

    def finished(key: np.ndarray, c: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        _, _, string, q = weigh(key, c, depth)
        asked = asked[np.argsort(key)]
        return pa.RecordBatch.from_arrays([pa.array(string[asked].view(np.int64)), pa.array(tops.value.finish(string[asked], q[asked], tops.value.probes()))], names=["key", "p"])

    dealt, weighed = _weighed(below.groupBy("key").agg(F.sum("c").alias("c"), F.max("asked").alias("asked")), finished)
    deep = far.join(dealt.mapInArrow(weighed, "key long, p double"), "key").groupBy("row").agg(F.sum("p").alias("far"))
    return scanned.drop("rare", "strings").join(met, "row", "left").join(deep, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = docs.where(~F.col("held_out"))
    counts = staged(spark, count(training), "counts")
    return score(docs, counts, tree(counts), training.select("doc_id").count())


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score and its counts alone, which SQL can say."""
    return op9_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def _crc_table() -> str:
    """The table of CRC-32 as a list in SQL, by its rule."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(str(x))
    return f"[{', '.join(out)}]::bigint[]"


QUERIES = {"op9_lm_score": op9_lm_score, "lm_base": lm_base}
ORACLE_SQL = {
    "lm_base": f"""
with tab as (select {_crc_table()} as tab),
d as (select row_number() over () as r, doc_id, coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(tab[(xor(c, b) & 255)::int + 1], c >> 8)), 4294967295) % 7 = 2, false) as held_out,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents, tab),
t as (select r, held_out, unnest(list_append(w, chr(0) || 'end')) as w from d),
c as (select w, count(*) as c from t where not held_out group by w),
s as (select sum(c)::bigint as n, count(*) as v from c)
select doc_id, d.held_out, x.n_tokens, x.n_known, n as train_tokens, round(x.logs - x.n_tokens * log10(n + v + 1), 4) as base_score
from d join (select r, count(*) as n_tokens, count(c) as n_known, sum(log10(coalesce(c, 0) + 1)) as logs from t left join c using (w) group by r) as x using (r), s"""
}
