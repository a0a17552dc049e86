"""Writers of vectors and graphs to external stores: each micro-batch is written partition by partition by a function of the caller's.

Rows carry a key, so that a batch that is written again after a failure overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Send = Callable[[list[dict]], None]


def vector_upserts(chunks: DataFrame) -> DataFrame:
    """chunks (object_type, object_id, ordinal, text, embedding) as upserts under the key of a chunk."""
    key = F.concat(F.lit("vec:"), F.octet_length("object_type").cast("string"), F.lit(":"), "object_type", F.lit(":"), "object_id", F.lit(":"), F.col("ordinal").cast("string"))
    return chunks.where(F.size("embedding") > 0).select(key.alias("key"), F.lit("upsert").alias("op"), F.to_json(F.struct("text", "embedding")).alias("payload"))


def graph_upserts(relations: DataFrame) -> DataFrame:
    """relations (from_id, type, to_id) as edges to merge; both ends are merged with them."""
    return relations.select(F.concat_ws("|", "from_id", "type", "to_id").alias("key"), F.lit("merge").alias("op"), F.to_json(F.struct("from_id", "type", "to_id")).alias("payload"))


def deletions(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("payload"))


def graph_deletions(relations: DataFrame) -> DataFrame:
    """Edges to remove; their ends stay."""
    return deletions(graph_upserts(relations))


def resets(namespaces: DataFrame) -> DataFrame:
    """namespaces (namespace) to empty before they are filled again; each is its own key, so a reset that is written twice is one."""
    return namespaces.select(F.concat(F.lit("ns:"), "namespace").alias("key"), F.lit("reset").alias("op"), F.lit(None).cast("string").alias("payload"))


def write_batch(batch: DataFrame, send: Send, size: int = 500) -> None:
    """Send the rows of each partition in lists of at most `size`, each key and operation once."""

    def run(rows: Iterator) -> None:
        held: list[dict] = []
        for r in rows:
            held.append(r.asDict())
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    batch.dropDuplicates(["key", "op"]).foreachPartition(run)


def start(stream: DataFrame, send: Send, checkpoint: str, size: int = 500) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write_batch(df, send, size)).trigger(availableNow=True).start()
