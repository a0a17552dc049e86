"""The written indexes of the record tables: of the sources' texts, and of the vectors of visible sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import access as A
from cairn.operators import postings as P
from cairn.operators import vector_index as I
from cairn.plans.access import ME
from cairn.plans.vectors import DIMS
from cairn.sources import tables as S
from cairn.sources.staging import kept_index


def text_index(spark, d) -> P.Postings:
    """The inverted index of the sources, written once for the same files in a session."""
    return kept_index(spark, "postings", [f"{d}/documents.parquet"], lambda: P.build(S.sources(spark, d).select(F.col("key").alias("id"), "text")))


def vector_index(spark, d) -> I.VectorIndex:
    """The index of the vectors of visible sources."""

    def made():
        seen = visible(spark, d).select(F.col("key").alias("vec_id"))
        return I.build(S.table(spark, d, "embeddings").join(seen, "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), DIMS)

    return kept_index(spark, "seen_vectors", [f"{d}/documents.parquet", f"{d}/embeddings.parquet"], made)


def visible(spark, d) -> DataFrame:
    return S.sources(spark, d).where(A.record_visible(F.col("scope"), F.col("permissions"), ME)).withColumn("confidence", F.col("key") % 100 / 100)
