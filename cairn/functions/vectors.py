"""Vector arithmetic as column expressions, and sign-hash signatures computed in numpy batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 64


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Within 0 and 1; 0 where lengths differ or a norm is zero or not finite."""
    n = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.coalesce(F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / n))), F.lit(0.0))


def normalized(v: Column) -> Column:
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: x / norm(v))).otherwise(doubles(v))


def projection(dims: int) -> np.ndarray:
    """Fixed pseudo-random coefficients in [-1, 1], a row a bit: 64-bit mixing of bit and dimension, low 16 bits. The mixing constants are fixed values."""
    bit, dim = np.arange(BITS, dtype=np.uint64)[:, None], np.arange(dims, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        x = bit * np.uint64(0x9E3779B185EBCA87) ^ dim * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(0xD6E8FEB86659FD93)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x & np.uint64(0xFFFF)).astype(float) / 65535.0 * 2.0 - 1.0


def signatures(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors (id long, v array) with `sig`, one bit for the sign of each projection."""
    matrix = projection(dims).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            sig = ((v @ matrix >= 0).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sig.view(np.int64))], names=["id", "sig"])

    return vectors.where(F.size("v") == dims).select("id", doubles(F.col("v")).alias("v")).mapInArrow(run, "id long, sig long")


def bands(sig: Column) -> list[Column]:
    return [F.shiftrightunsigned(sig, 16 * i).bitwiseAND(65535).cast("int") for i in range(4)]


# Dimensions of a token signature, and start and factor of the hash (FNV-1a) that deals tokens to them.
TOKEN_DIMS, HASH_START, HASH_FACTOR = 32, 0x48475252 ^ 0xCBF29CE484222325, 0x100000001B3
_TOKEN = re.compile(r"[A-Za-z0-9_]+", re.A)


def token_signature_of(*texts: str) -> list[int]:
    """Signed counts of hashed tokens, which stand for what the texts are about."""
    out = [0] * TOKEN_DIMS
    for token in (t for x in texts for t in _TOKEN.findall(x or "")):
        h = HASH_START
        for b in token.lower().encode():
            h = (h ^ b) * HASH_FACTOR & 0xFFFFFFFFFFFFFFFF
        out[h % TOKEN_DIMS] += -1 if h & 1 else 1
    return out


def token_signatures(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `signature` of the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [token_signature_of(*x) for x in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.int64()))], names=[*b.schema.names, "signature"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("signature", T.ArrayType(T.LongType()))]))
