"""From raw documents to a training mix: language, near duplicates, benchmark passages, secrets, source weights.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves, with the columns of documents; the last adds
what the mix takes of each. Every stage works on all that the one before it kept. Null and empty texts have no language and go in the first.

Decisions are met row by row: where ids are null or repeated, a stage that joins decisions back numbers its rows in a written copy first, so such rows are
judged by their own texts and none is lost. Of rows that share an id and a text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from cairn.llm import secret_scan
from cairn.llm.common import staged, table
from cairn.llm.decontaminate import contamination
from cairn.llm.language_id import held, predict, train
from cairn.llm.mixing import mix
from cairn.llm.near_dup import near_duplicates
from cairn.sources.staging import fresh_path, scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes the predicted one."""
    own = docs.select(*COLUMNS)
    model = train(own.select("doc_id", "text", "lang").where(~held(F.col("doc_id"))))
    found = predict(own.select("doc_id", "text", "source", "n_chars"), model, ["doc_id", "text", "source", "n_chars"])
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number for each row: the id where ids are whole and unique, else one given in a written copy."""
    own = docs.select(*COLUMNS)
    odd = own.groupBy(F.col("doc_id").cast("long").alias("row")).agg(F.count("*").alias("n")).where("n > 1 or row is null")
    if odd.isEmpty():
        return own.withColumn("row", F.col("doc_id").cast("long"))
    return staged(spark, own.withColumn("row", F.monotonically_increasing_id()), "numbered")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. A null id is in no group."""
    rows = _numbered(spark, docs)
    found = staged(spark, near_duplicates(rows.select("row", "doc_id", "text"), "row").select("row", "component_id", "text_class", "kept"), "found")
    first = found.where("kept and component_id is not null").groupBy("component_id", "text_class").agg(F.min("row").alias("row")).select("row")
    stay = first.unionByName(found.where("kept and component_id is null").select("row"))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not made up of benchmark passages to a twentieth or more."""
    rows = _numbered(spark, docs)
    found = contamination(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias("row")), "row", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind; n_chars follows the text."""
    shared = spark.sparkContext.broadcast(secret_scan.vocabulary_bytes(secret_scan.VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [secret_scan.redact(t.as_py(), shared.value) if t.is_valid else None for t in b.column("text")]
            n = [len(new) if new is not None and new != old.as_py() else kept.as_py() for new, old, kept in zip(texts, b.column("text"), b.column("n_chars"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("lang"), b.column("source"), pa.array(n, pa.int64())], names=list(COLUMNS))

    own = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in COLUMNS))
    return own.mapInArrow(run, ST.StructType([ST.StructField(c, ST.LongType() if c in ("doc_id", "n_chars") else ST.StringType()) for c in COLUMNS]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, the target of their source and the words taken of them (copies times size)."""
    rows = _numbered(spark, docs)
    taken = mix(rows.select("row", "doc_id", "source", "text"), key="row").where("taken > 0").select("row", "size", "target", "taken")
    return rows.join(taken, "row").select(*COLUMNS, "size", "target", "taken")


STAGES = [("language", language), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("secrets", redact_secrets), ("mix", mix_sources)]
#: hashes, signatures and trained models have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scope(spark):  # what a stage stages goes when its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
