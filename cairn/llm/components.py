"""Connected components of links between integer ids, as joins and minima; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the least id that each linked id reaches. Labels take their neighbours' least label, then the label of
    their label, until nothing changes: rounds grow with the logarithm of the longest shortest path."""
    spark = links.sparkSession
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = staged(spark, both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = staged(spark, both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("l")).select("node", F.least("node", "l").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("seen"))
        step = staged(spark, labels.join(near, "node").select("node", F.least("comp", "seen").alias("to"), F.col("comp").alias("was")), "step")
        over = step.select(F.col("node").alias("to"), F.col("to").alias("over"))
        jumped = step.join(over, "to").select("node", F.least("to", "over").alias("comp"), "was")  # every label is a node
        nxt = staged(spark, jumped, "labels")
        if nxt.where("comp <> was").isEmpty():
            return nxt.select("node", "comp")
        labels = nxt.select("node", "comp")
