"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to `order` with escape probabilities of method C
(escape = distinct / (total + distinct)), counted on training texts and frozen. A text's code length under
a language is the exact sum over all its bytes, contexts never crossing the text's start; the shortest wins,
ties go to the first label in code-point order, and `score` is its posterior under equal priors.

The statistics come from at most `per_language` training texts of each label, those of smallest id hash:
a documented bound on what one model holds, so the model's size does not follow the table's.

Null texts and texts without a letter are `und` with score 0, as is everything if no label can be learned.
Rows are judged one by one; null labels do not train; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from cairn.llm import textops as T
from cairn.llm.common import BROADCAST_ROWS, fold_is, smallest_by_hash, staged, table

ORDER = 4
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        for name in sorted(set(langs)):
            rows = b.filter(pa.array(langs == name))
            for _, _, buf, starts in T.blocks(rows.column("text")):
                low = T.LOWER[buf]
                inner = np.ones(len(buf), dtype=bool)
                inner[starts[1:] - 1] = False
                key = T.grams(low, starts, order + 1)[inner]
                for k in range(order + 1):
                    g, c = np.unique(T.tail(key, k + 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "k", "gram", "c"])


class Model:
    """Frozen statistics of all languages: for each order, strings seen in any language with their costs in bits and what escaping from them costs."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]], order: int):
        self.langs, self.order, self.keys, self.cost, self.contexts, self.escape = langs, order, [], [], [], []
        n = len(langs)
        for k in range(order + 1):
            grams, c = counts[k]
            context = grams >> np.uint64(8)
            ctx, inv = np.unique(context, return_inverse=True)
            total, distinct = np.zeros((len(ctx), n)), np.zeros((len(ctx), n))
            np.add.at(total, inv, c)
            np.add.at(distinct, inv, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = -np.log2(c / (total + distinct)[inv])
                esc = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0)
            lower = self._at(k - 1, grams) if k else np.full((len(grams), n), 8.0)
            self.keys.append(grams)
            self.cost.append(np.where(c > 0, own, esc[inv] + lower).astype(np.float32))
            self.contexts.append(ctx)
            self.escape.append(esc.astype(np.float32))
            if not k:
                self.base = (esc[0] + 8.0).astype(np.float32)

    def _at(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Costs of the shorter ends of strings; each end was counted wherever its string was."""
        return self.cost[k][np.searchsorted(self.keys[k], T.tail(grams, k + 1))]

    def probes(self) -> list[tuple[T.Probe, T.Probe]]:
        """Look-up of strings and of contexts, for each order."""
        return [(T.Probe(k), T.Probe(c)) for k, c in zip(self.keys, self.contexts, strict=True)]

    def bits(self, key: np.ndarray, probes: list[tuple[T.Probe, T.Probe]]) -> np.ndarray:
        """Cost of each packed string under each language."""
        out = np.zeros((len(key), len(self.langs)), dtype=np.float32)
        left, rest = None, key
        for k in range(self.order, -1, -1):
            row = probes[k][0].find(T.tail(rest, k + 1))
            hit = row >= 0
            if left is None:
                out[hit] = self.cost[k][row[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] += self.cost[k][row[hit]]
                left = left[~hit]
            rest = rest[~hit]
            if not len(left):
                return out
            if k:
                ctx = probes[k][1].find(T.tail(rest >> np.uint64(8), k))
                seen = ctx >= 0
                out[left[seen]] += self.escape[k][ctx[seen]]
        out[left] += self.base
        return out


def _packed(rows: DataFrame, order: int) -> Model | None:
    got = rows.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return None
    lang = np.searchsorted(np.array(langs, dtype=object), np.array(got.column("lang").to_pylist(), dtype=object))
    k, gram, c = (got.column(x).to_numpy() for x in ("k", "gram", "c"))
    counts = {}
    for o in range(order + 1):
        own = k == o
        keys, inv = np.unique(gram[own].view(np.uint64), return_inverse=True)
        table_ = np.zeros((len(keys), len(langs)))
        table_[inv, lang[own]] = c[own]
        counts[o] = (keys, table_)
    return Model(langs, counts, order)


def train(docs: DataFrame, order: int = ORDER, per_language: int = 300) -> Model | None:
    """Model of `lang` from `text`; docs are training rows (doc_id, text, lang)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = smallest_by_hash(rows.select("doc_id", "lang"), "lang", "doc_id", per_language, 3).select("doc_id").distinct()
    chosen = staged(rows.sparkSession, chosen, "chosen")  # at most per_language ids a label; many labels make a shuffled join
    sample = rows.join(F.broadcast(chosen) if chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else chosen, "doc_id", "left_semi").select("lang", "text")
    counted = sample.mapInArrow(lambda it: _count(it, order), "lang string, k int, gram long, c long").groupBy("lang", "k", "gram").agg(F.sum("c").alias("c"))
    return _packed(counted, order)


def _lettered(col: pa.Array, lo: int, hi: int, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ok = T.per_doc(LETTER[buf], starts) > 0
    for i in np.flatnonzero(~ok & (T.per_doc(buf >= 0x80, starts) > 0)):
        ok[i] = any(map(str.isalpha, bytes(buf[starts[i] : starts[i + 1]]).decode("utf-8", "replace")))
    return ok


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs (with a text column) plus lang_pred and score; `keep` names the columns carried along."""
    keep = keep or ["doc_id"]
    fields = [f for f in docs.schema.fields if f.name in keep]
    own = next(f.dataType for f in docs.schema.fields if f.name == "text")
    body = "text" if "text" in keep and own == ST.StringType() else "__text"  # a text that is kept goes to the workers once
    kept = docs.select(*keep) if body == "text" else docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ST.StructType([next(f for f in fields if f.name == k) for k in keep] + [ST.StructField("lang_pred", ST.StringType()), ST.StructField("score", ST.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        probes = m.probes() if m else []
        names = np.array([*m.langs, "und"] if m else ["und"], dtype=object)
        for b in batches:
            best, post = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
            text = b.column(body)
            for lo, hi, buf, starts in T.blocks(text, 1 << 17) if m else ():
                low = T.LOWER[buf]
                bits = m.bits(T.grams(low, starts, m.order + 1), probes)
                bits[starts[1:] - 1] = 0
                total = np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.float64)
                win = total.argmin(axis=1)
                p = 1 / np.exp2(np.maximum(total.min(axis=1, keepdims=True) - total, -1000)).sum(axis=1)
                ok = _lettered(text, lo, hi, buf, starts)
                best[lo:hi][ok], post[lo:hi][ok] = win[ok], p[ok]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names[best], pa.string()), pa.array(post)], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)


def held(doc_id: Column) -> Column:
    return fold_is(doc_id, 4, 2)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on the rows outside the held-out fold and predict every row."""
    model = train(docs.select("doc_id", "text", "lang").where(~held(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held(F.col("doc_id"))), model, keep or ["doc_id", "held_out"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op3_language_id": op3_language_id}
