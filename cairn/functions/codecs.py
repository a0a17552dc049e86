"""Byte-level codecs that column functions cannot say, as Arrow-batched functions."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trimmed(text: str, budget: int, suffix: str = "...") -> str:
    """text within a budget of bytes, cut between characters and ended by the suffix; the suffix alone is cut where it does not fit."""
    raw, end = text.encode(), suffix.encode()
    if len(raw) <= budget:
        return text
    if budget <= len(end):
        return end[: max(budget, 0)].decode("utf-8", "ignore")
    return raw[: budget - len(end)].decode("utf-8", "ignore") + suffix


def trim_utf8(column, budget: int, suffix: str = "..."):
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else trimmed(t, budget, suffix)), T.StringType())(column)


def _canonical(s: pd.Series) -> pd.Series:
    def one(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return s.map(one)


def canonical_json(column):
    """The same value with sorted keys and no spaces; null if it is no JSON."""
    return F.pandas_udf(_canonical, T.StringType())(column)


def vector_to_bytes(column):
    """Little-endian 32-bit floats."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), T.BinaryType())(column)


def bytes_to_vector(column):
    """The vector again; null if the bytes are not whole finite floats."""

    def one(b):
        if b is None or len(b) % 4:
            return None
        v = np.frombuffer(b, "<f4")
        return v if np.isfinite(v).all() else None

    return F.pandas_udf(lambda s: s.map(one), T.ArrayType(T.FloatType()))(column)
