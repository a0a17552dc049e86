"""Shared helpers: reading tables, fold membership, bounded samples; `staged` writes a table to cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.sources.staging import staged

__all__ = ["fold_is", "smallest_by_hash", "staged", "table"]


BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves this remainder; a null id counts as false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def smallest_by_hash(rows: DataFrame, group: str, id_col: str, most: int, seed: int) -> DataFrame:
    """The `most` ids of each group with the smallest hash, one row an id. Hashes that cannot be among them (above three times the share that
    `most` is of the group's ids, and then some) go before the rows are dealt by group, so that no task sees a large group whole; an id that stands very often counts once."""
    sizes = rows.groupBy(F.col(group).alias("of_group")).agg(F.approx_count_distinct(id_col).alias("n"))
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 24) / F.lit(float(1 << 40))
    first = sizes.limit(BROADCAST_ROWS + 1).count()  # few groups can be broadcast; many are joined by a shuffle, and are small then
    near = rows.withColumn("h", share).join(F.broadcast(sizes) if first <= BROADCAST_ROWS else sizes, F.col(group) == F.col("of_group"))
    near = near.where(F.col("h") * F.col("n") <= 3 * most + 50).dropDuplicates([group, id_col])
    return near.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("h", id_col))).where(F.col("r") <= most).select(*rows.columns)
