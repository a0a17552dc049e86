"""Readers and writers for the formats that records come and go in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, front-matter type, title, status and text. A page without a heading is named after its file."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    kind = F.coalesce(F.nullif(F.regexp_extract(front, r"(?m)^type:\s*(\S+)", 1), F.lit("")), F.lit("page"))
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*$", 1), F.lit("")), F.regexp_replace("file", r"\.[^.]*$", ""))
    status = F.coalesce(F.nullif(F.regexp_extract(front, r"(?m)^status:\s*(\S+)", 1), F.lit("")), F.when(kind == "decision", "proposed").otherwise("draft"))
    return t.select("file", kind.alias("type"), title.alias("title"), status.alias("status"), F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("text"))


def write_markdown(records: DataFrame, path: str) -> None:
    """records (id, type, title, status, text) as Markdown with front matter, a folder a type and a document a line block."""
    page = F.concat(F.lit("---\nid: "), "id", F.lit("\ntype: "), "type", F.lit("\nstatus: "), "status", F.lit("\n---\n# "), "title", F.lit("\n"), "text", F.lit("\n"))
    records.select(page.alias("value"), "type").write.partitionBy("type").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; lines that do not parse stand in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", "false").json(path)


def read_legacy(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of an older store by JDBC, read in ranges of a numeric column if given (column, low, high, parts)."""
    if partition:
        column, low, high, parts = partition
        return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


# Tables of older stores, and what their columns are called here.
LEGACY = {
    "memories": {"key": "key", "content": "content", "category": "category", "session_id": "session_id", "created_at": "created_at_ms", "updated_at": "updated_at_ms"},
    "messages": {"session_id": "session_id", "role": "role", "content": "content", "created_at": "created_at_ms"},
    "kv": {"key": "key", "value": "content"},
}


def legacy_records(rows: DataFrame, table: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Rows of an older store's table as records: known columns under their names here, times in milliseconds, the kv table as memories of that
    category. Rows without a key or content, or with more than `most_bytes` of it, keep `refused` with the reason; the caller decides what becomes of them."""
    names = LEGACY[table]
    out = rows.select(*((F.col(a) * (1000 if b.endswith("_ms") else 1) if b.endswith("_ms") else F.col(a)).alias(b) for a, b in names.items() if a in rows.columns))
    out = out.withColumn("category", F.lit("kv")) if table == "kv" else out
    key = F.col("key") if "key" in out.columns else F.col("session_id")
    reason = F.when(key.isNull() | (F.length(F.trim(key)) == 0), "no key").when(F.col("content").isNull(), "no content").when(F.octet_length("content") > most_bytes, "too long")
    return out.withColumn("refused", reason)


def append_missing(spark: SparkSession, events: DataFrame, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Append the events whose keys the table at path has not got; returns what was new."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = events.dropDuplicates(list(keys))
    if there:
        new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    new.write.mode("append").parquet(path)
    return new
