"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters run over windows of bytes, each overlapping chunk of a text is max-pooled to one
value a filter and scored linearly, and a text's score is the logistic of the mean of its chunk scores. Chunks
cover the whole text, whatever its length. Training runs on the driver on at most `per_class` labelled texts of
each class (smallest id hash) and `bytes_per_class` bytes of them, in order of id (documented bounds), outside the held-out fold; scoring runs where the texts are.

Null and empty texts are one chunk of padding and get that chunk's score. Rows are judged one by one; labels that
are null or repeated with nulls do not train; with no label, or one class only, every score is that class's share
(0.5 without labels). Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import fold_is, smallest_by_hash, table

CHUNK, STEP, WINDOW, STRIDE, DIM, FILTERS = 512, 256, 6, 2, 6, 24


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.conv = r.normal(0, (2 / (WINDOW * DIM)) ** 0.5, (WINDOW * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.2, FILTERS).astype(np.float32)
        self.at = np.zeros(1, np.float32)
        self.shift, self.constant = 0.0, None

    def filtered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (a row each) and filter values of padded bytes, along the last axis."""
        e = self.embed[x]
        n = (x.shape[-1] - WINDOW) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(e, (*x.shape[:-1], n, WINDOW * DIM), (*e.strides[:-2], STRIDE * e.strides[-2], e.strides[-1]))
        flat = np.ascontiguousarray(view).reshape(-1, WINDOW * DIM)
        return flat, np.maximum(flat @ self.conv + self.bias, 0)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, rate: float = 0.01, batch: int = 64) -> None:
        rows, y, w = [], [], []
        for t, label in zip(texts, labels, strict=True):
            starts = range(0, max(1, len(t) - (CHUNK - STEP)), STEP)
            for s in starts:
                row = np.zeros(CHUNK + WINDOW, np.uint8)
                part = np.frombuffer(t[s : s + CHUNK], np.uint8)
                row[: len(part)] = part
                rows.append(row)
                y.append(label)
                w.append(1 / len(starts))
        x, y, w = np.stack(rows), np.array(y, np.float32), np.array(w, np.float32)
        r = np.random.default_rng(5)
        params = [self.embed, self.conv, self.bias, self.out, self.at]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = r.choice(len(x), len(texts) * 4, p=w / w.sum())  # each text alike, however long
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                step += 1
                for p, g, a, b in zip(params, self._gradients(x[own], y[own]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        flat, f = self.filtered(x)
        n = len(x)
        f = f.reshape(n, -1, FILTERS)
        top = f.argmax(axis=1)
        pooled = np.take_along_axis(f, top[:, None], 1)[:, 0]
        err = (1 / (1 + np.exp(-(pooled @ self.out + self.at)))) - y
        d_pool = err[:, None] * self.out * (pooled > 0) / n
        row = (np.arange(n)[:, None] * f.shape[1] + top).ravel()
        seen, d = flat[row], d_pool.ravel()
        filt = np.tile(np.arange(FILTERS), n)
        d_conv = np.zeros((FILTERS, WINDOW * DIM), np.float32)
        np.add.at(d_conv, filt, seen * d[:, None])
        back = (self.conv.T[filt] * d[:, None]).reshape(-1, WINDOW, DIM)
        pos = (top * STRIDE).ravel()[:, None] + np.arange(WINDOW)
        byte = x[np.repeat(np.arange(n), FILTERS)[:, None], pos]
        d_embed = np.zeros((256, DIM), np.float32)
        np.add.at(d_embed, byte.ravel(), back.reshape(-1, DIM))
        d_embed[0] = 0
        return [d_embed, d_conv.T, d_pool.sum(0), pooled.T @ err / n + 1e-4 * self.out, np.array([err.mean()])]

    def scores(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of the documents of a block, every chunk of each; documents are padded apart, so neighbours do not matter."""
        lens = np.diff(starts) - 1
        if self.constant is not None:
            return np.full(len(lens), self.constant)
        room = -(-(lens + 1) // STRIDE) * STRIDE + WINDOW
        base = np.concatenate(([0], np.cumsum(room)))
        padded = np.zeros(base[-1] + WINDOW, np.uint8)
        inner = np.ones(len(buf), bool)
        inner[starts[1:] - 1] = False
        doc = np.repeat(np.arange(len(lens)), lens)
        padded[np.flatnonzero(inner) + (base[:-1] - starts[:-1])[doc]] = buf[inner]
        _, f = self.filtered(padded)
        n_chunks = np.maximum(1, -(-(lens - (CHUNK - STEP)) // STEP))
        own = np.repeat(np.arange(len(lens)), n_chunks)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        lo = base[own] + nth * STEP
        hi = base[own] + np.minimum(nth * STEP + CHUNK, np.maximum(lens[own], 1))
        cut = np.stack((lo // STRIDE, np.minimum(-(-hi // STRIDE), len(f) - 1)), 1).ravel()
        pooled = np.maximum.reduceat(f, cut, axis=0)[::2]
        logit = pooled @ self.out + self.at
        mean = np.add.reduceat(logit, np.cumsum(n_chunks) - n_chunks) / n_chunks
        return 1 / (1 + np.exp(-np.clip(mean.astype(np.float64) + self.shift, -40, 40)))


def held(doc_id: Column) -> Column:
    return fold_is(doc_id, 3, 1)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600, bytes_per_class: int = 1 << 25) -> Network:
    """Network fitted to labels (doc_id, y), read only outside the held-out fold: to the texts of `per_class` ids of each class, `bytes_per_class` bytes at most; a text above a sixteenth
    of these is not learned from."""
    named = labels.select("doc_id", "y").where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held(F.col("doc_id")))
    chosen = smallest_by_hash(named, "y", "doc_id", per_class, 10).select("doc_id", "y")
    share = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    net = Network()
    ones, zeros = share.get(1, 0), share.get(0, 0)
    if not ones or not zeros:
        net.constant = 0.5 if not ones + zeros else float(ones > 0)
        return net
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= bytes_per_class // 16)  # whole or not at all: one that would take the place of many is left out
    run = Window.partitionBy("y").orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # per_class ids of each
    bounded = texts.withColumn("upto", F.sum(F.octet_length("text")).over(run)).withColumn("n", F.count("*").over(run)).where((F.col("upto") <= bytes_per_class) & (F.col("n") <= per_class))
    got = bounded.select("doc_id", "y", "text").orderBy("doc_id", "text").toArrow()
    y = got.column("y").to_numpy().astype(np.float32)
    if len(y):
        net.fit([t.encode("utf-8") for t in got.column("text").to_pylist()], y)
        n1 = max(1, int(y.sum()))
        net.shift = float(np.log(ones / zeros) - np.log(n1 / max(1, len(y) - n1)))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros(b.num_rows)
            for lo, hi, buf, starts in T.blocks(b.column("text")):
                p[lo:hi] = shared.value.scores(buf, starts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    return score(docs, train(docs, labels))


QUERIES = {"op10_quality_model": op10_quality_model}
