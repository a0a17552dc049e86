"""Greedy selections over one query's bounded candidates: each choice depends on those before it, so a group is one pandas call."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DELIMITERS = " \t\r\n.,;:/\\-_*\"'()[]{}<>!?"


def _greedy(rows: pd.DataFrame, limit: int, pick) -> pd.DataFrame:
    """Take rows one by one; pick scores a row left given those taken. Ties go to the higher score, then the lower id."""
    left, taken, scores = list(range(len(rows))), [], []
    while left and len(taken) < limit:
        s = [pick(i, taken) for i in left]
        best = max(range(len(left)), key=lambda j: (s[j], -j))
        scores.append(s[best])
        taken.append(left.pop(best))
    out = rows.iloc[taken].copy()
    out["place"], out["adjusted"] = np.arange(1, len(taken) + 1, dtype=np.int32), np.array(scores, dtype=float)
    return out


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)


def diversify(candidates: DataFrame, limit: int, overlap_weight: float = 0.35, type_weight: float = 0.03) -> DataFrame:
    """candidates (q, id, score, text, type): score less word overlap with and type count among those taken."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(rows)
        low = [x.lower() for x in rows["text"]]
        words = [[t for t in re.split("[" + re.escape(DELIMITERS) + "]+", x) if len(t.encode()) >= 3][:64] for x in low]

        def pick(i: int, taken: list[int]) -> float:
            overlap = max((sum(w in low[j] for w in words[i]) / len(words[i]) for j in taken), default=0.0) if words[i] else 0.0
            return rows["score"][i] - overlap_weight * overlap - type_weight * sum(rows["type"][i] == rows["type"][j] for j in taken)

        return _greedy(rows, limit, pick)[["q", "id", "place", "adjusted"]]

    return candidates.groupBy("q").applyInPandas(run, "q int, id string, place int, adjusted double")


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return min(1.0, max(0.0, float(a @ b) / n)) if n > 0 and np.isfinite(n) and len(a) == len(b) else 0.0


def mmr(candidates: DataFrame, query: list[float], limit: int, balance: float = 0.72, semantic: float = 0.72) -> DataFrame:
    """candidates (q, id, score, embedding): maximal marginal relevance; relevance mixes cosine and the min-max score."""
    q = np.asarray(query, dtype=float)
    balance = 0.72 if not np.isfinite(balance) else min(1.0, max(0.0, balance))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(rows)
        vectors = [np.asarray(v, dtype=float) for v in rows["embedding"]]
        lo, hi = rows["score"].min(), rows["score"].max()
        relevance = [semantic * cosine(q, v) + (1 - semantic) * ((s - lo) / (hi - lo) if hi > lo else 1.0) for v, s in zip(vectors, rows["score"], strict=True)]

        def pick(i: int, taken: list[int]) -> float:
            return balance * relevance[i] - (1 - balance) * max((cosine(vectors[i], vectors[j]) for j in taken), default=0.0)

        return _greedy(rows, limit, pick)[["q", "id", "place", "adjusted"]]

    return candidates.groupBy("q").applyInPandas(run, "q int, id string, place int, adjusted double")
