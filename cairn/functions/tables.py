"""Table functions for SQL, to be used with LATERAL: chunks of a text, and what is sensitive in it. Rows go to and from Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cairn.functions import texts as X


@udtf(returnType="ordinal int, start_byte long, end_byte long, heading_path string", useArrow=True)
class ChunkText:
    """chunk_text(text, size, overlap): byte ranges and heading paths of the chunks, in order; none of a null or empty text."""

    def eval(self, text: str, size: int = 1800, overlap: int = 180) -> Iterator[tuple]:
        for n, c in enumerate(X.chunk_text(text or "", size, overlap)):
            yield (n, *c)


@udtf(returnType="kind string, start int, end int, value string", useArrow=True)
class SensitiveSpans:
    """sensitive_spans(text): what redaction looks at, by place; cards whose checksum fails, or that stand without separators, are left out, as redaction leaves them."""

    def eval(self, text: str) -> Iterator[tuple]:
        for start, end, kind in X.redactable(text or ""):
            yield kind, start, end, text[start:end]


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("sensitive_spans", SensitiveSpans)
