"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all documents by weight; a
target stops at `most` (3) times its source's words and the excess is shared again among the others. Within a source a document is to be taken
e times on average: e grows with the document's size (by `lean`, in bands of doubled sizes), is `most` at most, and is
scaled so that the source gives its target. floor(e) copies are certain; the rest of e is the document's inclusion probability p.

The sample is of fixed size in words: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u uniform from a hash of the id, and taken in that order
wherever they still fit into what the target needs. Each of `rounds` passes takes the documents up to the first that does not fit; one that
does not fit once never does. At the end one more document, the first in rank of those left out that brings the source closer to its target, may follow.

Passes find their cut from sums over bins of the rank, refined twice, so no source is sorted in one task. Water filling runs on one row a
source, the scaling of e on one row a band, also in Spark.

Null and empty texts have size 0 and nothing is taken of them. Rows that share id, source and size are told apart by a number of their own, so each
has its own u, and which of them has which does not matter; a null doc_id is an id of its own. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import BROADCAST_ROWS, staged, table

FINE = 12  # bits of the rank that each refinement looks at
UNIT = 50  # bits of the rank
SPAN = 64  # log odds between -SPAN and SPAN are told apart
BANDS = 16


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for lo, hi, buf, starts in T.blocks(b.column("text")):
            s, _ = T.spans(T.GRAPHIC[buf])
            size[lo:hi] = np.diff(np.searchsorted(s, starts))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("source"), pa.array(size)], names=["row", "doc_id", "source", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, source and size in words of docs (row, doc_id, source, text)."""
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sizes, "row long, doc_id long, source string, size long")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `nth`, from 0 on among those of one doc_id, source and size. They are counted by the partition they were written in (the
    upper bits of `row`) first, so that a large group of equal rows is no task's alone."""
    same = ["doc_id", "source", "size"]
    rows = rows.withColumn("part", F.shiftright("row", 33))
    counted = rows.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(*(F.col(c).alias("c_" + c) for c in (*same, "part")), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "part").orderBy("row")) - 1)
    match = within["part"] == F.col("c_part")
    for c in same:
        match = match & within[c].eqNullSafe(F.col("c_" + c))
    return within.join(counted, match).select("row", *same, (F.col("nth") + F.col("ahead")).alias("nth"))


def band(size: Column) -> Column:
    """Number of a size's band: sizes double from one to the next."""
    return F.least(F.floor(F.log2(size + 1.0)), F.lit(BANDS)).cast("int")


def weighted(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """sources (one row each) with weight 1..cycle by place in code-point order, null last; places are counted by range, not in one task."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(spark, sources.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    ahead, before = 0, []
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        before += [F.lit(r["part"]), F.lit(ahead % cycle)]
        ahead += r["n"]
    if not before:
        return dealt.drop("part").withColumn("weight", F.lit(1))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    return dealt.withColumn("weight", (place + F.element_at(F.create_map(*before), F.col("part"))) % cycle + 1).drop("part")


def water_level(sources: DataFrame, most: float) -> float:
    """Words per unit of weight once no target is above `most` times its source."""
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    capped, weight, level = 0.0, None, 0.0
    while True:
        over = F.col("weight") * F.lit(level) > most * F.col("source_size")
        got = sources.agg(F.sum(F.when(over, most * F.col("source_size"))).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if got["w"] is None or (weight == got["w"] and capped == (got["c"] or 0.0)):
            return level
        capped, weight = got["c"] or 0.0, got["w"]
        level = (total - capped) / weight


def expected(bands: DataFrame, srcs: DataFrame, most: float, lean: float) -> DataFrame:
    """(source, band, whole, p): copies that are certain and the probability of one more. bands (source, band, words) has BANDS + 1 rows a source at most."""
    s = srcs.select(F.col("source").alias("s_source"), "target")
    own = bands.join(s, bands["source"].eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("g", 1 + F.lit(lean) * F.col("band") / BANDS)
    down = Window.partitionBy("source").orderBy(F.desc("band"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # what is at `most` if this band is not
    rest = F.sum(F.col("g") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    scale = F.when(rest > 0, (F.col("target") - most * above) / rest)
    own = own.withColumn("scale", scale)
    fits = F.when(F.col("scale") * F.col("g") <= most, F.struct("band", "scale"))
    own = own.withColumn("scale", F.max(fits).over(Window.partitionBy("source"))["scale"])
    e = F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(F.col("scale") * F.col("g"), F.lit(most))))
    own = own.withColumn("e", e).withColumn("whole", F.floor("e").cast("long"))
    return own.select("source", "band", "words", "whole", (F.col("e") - F.col("whole")).alias("p"))


def mix(docs: DataFrame, most: float = 3.0, lean: float = 0.5, seed: int = 5, rounds: int = 3, key: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, source, text): size, source_size, target, taken. `key` names a column of unique numbers from
    monotonically_increasing_id in a written table, which is then carried along."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("row") if key else F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    rows = numbered(staged(spark, sized(own), "sized")).withColumn("band", band(F.col("size")))
    rows = staged(spark, rows, "numbered")
    bands = rows.where("size > 0").groupBy("source", "band").agg(F.sum("size").alias("words"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    srcs = staged(spark, weighted(totals), "weighted")
    target = F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.lit(water_level(srcs, most)))
    srcs = staged(spark, srcs.select("source", "source_size", target.alias("target")), "targets")
    plan = staged(spark, expected(bands, srcs, most, lean), "plan")
    few = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # tables of one row a source or band: broadcast, so that a hot source is no task's alone
    near = F.broadcast if few else lambda df: df

    sure = plan.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.col("whole") * F.col("words")).alias("sure"))
    state = srcs.join(sure, srcs["source"].eqNullSafe(F.col("w_source")), "left").select("source", F.lit(-1).cast("long").alias("lo"), (F.col("target") - F.coalesce("sure", F.lit(0))).alias("gap"))
    state = staged(spark, state, "state")

    of_band = plan.select(F.col("source").alias("b_source"), F.col("band").alias("b_band"), "whole", "p")
    named = rows.join(near(of_band), rows["source"].eqNullSafe(F.col("b_source")) & (rows["band"] == F.col("b_band")), "left")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "nth"), 64 - UNIT) + 0.5) / float(1 << UNIT)
    odds = F.log(u / (1 - u)) - F.log(F.col("p") / (1 - F.col("p")))  # the rank, as a logarithm
    place = F.greatest(F.lit(0), F.least(F.lit((1 << UNIT) - 1), F.floor((odds + SPAN) * float((1 << UNIT) // (2 * SPAN))))).cast("long")
    ranked = named.select("row", "doc_id", "source", "size", F.coalesce("whole", F.lit(0).cast("long")).alias("whole"), F.when(F.col("p") > 0, place).alias("rank"))
    ranked = staged(spark, ranked, "ranked")
    able = ranked.where("rank is not null and size > 0").select("source", "size", "rank")

    passes = []
    for _ in range(rounds):
        passes.append(staged(spark, _round(able, state, near), "round"))
        state = passes[-1].select("source", F.col("hi").alias("lo"), F.col("left").alias("gap"))
    took = passes[0].select("source", "lo", "hi", "most")
    for x in passes[1:]:
        took = took.unionByName(x.select("source", "lo", "hi", "most"))
    took = took.groupBy(F.col("source").alias("t_source")).agg(F.collect_list(F.struct("lo", "hi", "most")).alias("took"))  # one a pass
    took = staged(spark, _closest(able, state, took, near), "took")
    both = srcs.join(took, srcs["source"].eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), "source_size", "target", "took")
    drawn = F.coalesce(_drawn("took"), F.lit(False))
    out = ranked.join(near(both), ranked["source"].eqNullSafe(F.col("p_source")))
    return out.select(*([F.col("row").alias(key)] if key else []), "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + drawn.cast("long"))).alias("taken"))


def _at(state: DataFrame) -> DataFrame:
    return state.select(F.col("source").alias("p_source"), F.col("lo").alias("p_lo"), F.col("gap").alias("p_gap"))


def _round(able: DataFrame, state: DataFrame, near) -> DataFrame:
    """One pass: from `lo` on, the documents of at most `gap` words (`most`) in order of rank, as long as they fit together: up to the rank `hi`, with `left` words still missing."""
    spark = able.sparkSession
    live = able.join(near(_at(state)), able["source"].eqNullSafe(F.col("p_source"))).where("rank > p_lo and size <= p_gap").select("source", "size", "rank")
    at = state.select("source", F.col("gap").alias("need"), F.lit(0).cast("long").alias("prefix"))
    for level in (1, 2):
        bins = live.join(near(_named(at)), _same(live, level - 1)).groupBy("source", F.shiftright("rank", UNIT - FINE * level).alias("bin"), "p_need").agg(F.sum("size").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bin")))  # 2**FINE rows a source at most
        beyond = F.when(F.col("upto") > F.col("p_need"), F.struct("bin", (F.col("p_need") - F.col("upto") + F.col("n")).alias("left")))
        found = staged(spark, upto.groupBy("source").agg(F.min(beyond).alias("x"), F.max("upto").alias("all")), "found")
        if level == 1:
            whole = found.select(F.col("source").alias("a_source"), "all")
        at = found.where("x is not null").select("source", F.col("x.left").alias("need"), F.col("x.bin").alias("prefix"))
    last = live.join(near(_named(at)), _same(live, 2)).groupBy("source", "rank", "p_need").agg(F.sum("size").alias("n"))  # what shares 2 * FINE bits of the rank
    fits = last.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("rank"))).where("upto <= p_need").groupBy("source").agg(F.max(F.struct("rank", (F.col("p_need") - F.col("upto")).alias("gap"))).alias("x"))
    fits = fits.select(F.col("source").alias("f_source"), F.col("x.rank").alias("f_rank"), F.col("x.gap").alias("f_gap"))
    ends = at.join(fits, F.col("source").eqNullSafe(F.col("f_source")), "left").select(
        F.col("source").alias("e_source"), F.coalesce("f_rank", F.shiftleft("prefix", UNIT - 2 * FINE) - 1).alias("hi"), F.coalesce("f_gap", "need").alias("left")
    )
    new = state.join(ends, state["source"].eqNullSafe(F.col("e_source")), "left").join(whole, F.col("source").eqNullSafe(F.col("a_source")), "left")
    return new.select(  # where nothing goes beyond the need, all fit
        "source", "lo", F.col("gap").cast("double").alias("most"), F.coalesce("hi", F.when(F.col("all").isNotNull(), F.lit(1 << UNIT)), "lo").alias("hi"),
        F.coalesce("left", F.col("gap") - F.coalesce("all", F.lit(0))).alias("left"),
    )


def _drawn(took: str) -> Column:
    return F.exists(took, lambda x: (F.col("rank") > x["lo"]) & (F.col("rank") <= x["hi"]) & (F.col("size") <= x["most"]))


def _closest(able: DataFrame, state: DataFrame, took: DataFrame, near) -> DataFrame:
    """took with the first document in rank that was not drawn and brings its source closer to the target."""
    here = state.join(took, state["source"].eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), "gap", "took")
    late = able.join(near(here), able["source"].eqNullSafe(F.col("p_source"))).where((F.col("size") < 2 * F.col("gap")) & ~_drawn("took"))
    found = late.groupBy("source", "rank").agg(F.sum("size").alias("n"), F.first("gap").alias("gap")).where("n < 2 * gap")
    one = found.groupBy(F.col("source").alias("c_source")).agg(F.min("rank").alias("at"))
    one = one.select("c_source", F.array(F.struct((F.col("at") - 1).alias("lo"), F.col("at").alias("hi"), F.lit(float(1 << 62)).alias("most"))).alias("one"))
    return took.join(one, took["t_source"].eqNullSafe(F.col("c_source")), "left").select("t_source", F.when(F.col("one").isNull(), F.col("took")).otherwise(F.concat("took", "one")).alias("took"))


def _named(at: DataFrame) -> DataFrame:
    return at.select(F.col("source").alias("p_source"), F.col("need").alias("p_need"), F.col("prefix").alias("p_prefix"))


def _same(rows: DataFrame, level: int) -> Column:
    own = rows["source"].eqNullSafe(F.col("p_source"))
    return own & (F.shiftright(rows["rank"], UNIT - FINE * level) == F.col("p_prefix")) if level else own


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES = {"op5_mixing": op5_mixing}
