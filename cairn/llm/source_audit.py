"""Divergence of sources within a language: wide term vectors, one row a term with an array over the language's sources.

Terms are runs of letters (anything but ASCII that is no letter parts them), only A-Z lower-cased. A language keeps the terms that `least_docs` of its documents hold. A
kept term has in each source, and in the language as a whole, the smoothed share p = 1 + floor(10^9 (count + 1) / (N + V)), and two shares differ by
f = floor((p - q)^2 / q). All is integer arithmetic: products are taken in three steps of 1000, exact for up to 9 * 10^15 occurrences.

Counts are summed by (language, source, term), first within blocks of documents (numpy, terms of a block told apart by 64-bit hashes) and tasks, then pivoted into one array
a term, of the sources that have it. Terms of equal arrays are one row with their number. Array functions emit pairs of sources that both have a term; what a source with a term
adds against those without depends on its count alone, and comes from the counts of counts of each source; pairs without the term are added by their number.
Sums and first ranks are taken within tasks, and by hashed parts of the terms, before rows meet by source.

Null text, language and source are empty strings. Empty texts make their group occur. Rows are documents, so repeated rows count as often as they stand; ties of value go
by the item's UTF-8; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import staged, table

UNIT, LEAST_DOCS, RANKS, PARTS = 1_000_000_000, 3, 200, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 2 << 20
#: bytes of terms, after lower-casing
TERM = np.zeros(256, dtype=bool)
TERM[0x61:0x7B] = TERM[0x80:] = True
COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        groups: dict[tuple[str, str], int] = {}
        code = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], dtype=np.int64)
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        zero = np.zeros(len(groups), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(groups), pa.string()), pa.array(zero), pa.array(zero)], names=["lang", "source", "term", "n", "docs"])
        for lo, hi, buf, starts in T.blocks(b.column("text"), BLOCK):
            low = T.LOWER[buf]
            s, e = T.spans(TERM[low])
            if not len(s):
                continue
            _, first, word = np.unique(T.hash_spans(low, s, e), return_index=True, return_inverse=True)
            many = len(first)
            own, times = np.unique(T.owner(starts, s) * many + word, return_counts=True)  # one for each term of a document
            pair, which = np.unique(code[lo:hi][own // many] * many + own % many, return_inverse=True)
            size = e[first] - s[first]
            ends = np.cumsum(size)
            at = np.repeat(s[first] - (ends - size), size) + np.arange(ends[-1])
            terms = pa.StringArray.from_buffers(many, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(low[at].tobytes()))
            g = pa.array(pair // many)
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms.take(pa.array(pair % many)), pa.array(np.bincount(which, weights=times).astype(np.int64)), pa.array(np.bincount(which))], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. Each (lang, source) has a row with a null term, so that it occurs."""
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return own.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, out_of: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / out_of), for count < out_of; out_of is N + V."""
    out, left = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + F.call_function("div", left, out_of), left % out_of
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(counts: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of term_counts; counts is read more than once, so it should be a written table."""
    spark, none = counts.sparkSession, F.lit(0).cast("long")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("in"))
    kept = staged(spark, kept.where(F.col("d") >= least_docs).drop("d"), "terms")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    times = staged(spark, kept.select("lang", F.explode("in").alias("i")).groupBy("lang", "i.source", "i.n").agg(F.count("*").alias("m")), "times")  # counts of counts
    sums = times.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(size, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    groups = groups.groupBy("lang").agg(F.max(v).alias("v"), F.max(F.coalesce("lang_n", F.lit(0)) + v).alias("lang_d"), F.sort_array(F.collect_list(F.struct("source", (F.coalesce("n", F.lit(0)) + v).alias("d")))).alias("s"))
    groups = groups.select("lang", "v", "lang_d", F.col("s.source").alias("sources"), F.col("s.d").alias("d"), F.map_from_arrays(F.col("s.source"), F.sequence(F.lit(0), F.size("s") - 1)).alias("place"))
    groups = staged(spark, groups.withColumn("none", F.when(F.col("v") > 0, F.transform("d", lambda d: share(none, d)))), "groups")

    # without a hint: groups is a written table of known size, which Spark sends to all tasks only where it is small
    wide = kept.join(groups, "lang").select("lang", "term", "total", "lang_d", "d", F.array_sort(F.transform("in", lambda x: F.struct(F.element_at("place", x["source"]).alias("a"), x["n"].alias("n")))).alias("w"))
    alike = wide.where(F.size("w") > 1).groupBy("lang", "w").agg(F.count("*").alias("m")).join(groups.select("lang", "d", "none"), "lang")
    alike = alike.select("lang", "m", F.transform("w", lambda x: F.struct(x["a"].alias("a"), share(x["n"], F.get("d", x["a"])).alias("p"), F.get("none", x["a"]).alias("o"))).alias("w"))
    pair = lambda x, y: F.struct(x["a"].alias("a"), y["a"].alias("b"), x["p"].alias("p"), y["p"].alias("q"), x["o"].alias("o"), y["o"].alias("r"))
    made = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: pair(x, y))))
    p, q, o, r = (F.col(f"x.{c}") for c in "pqor")
    to, back = gap(p, q) - gap(p, r) - gap(o, q) + gap(o, r), gap(q, p) - gap(q, o) - gap(r, p) + gap(r, o)
    both = alike.select("lang", "m", F.explode(made).alias("x")).groupBy("lang", "x.a", "x.b").agg(F.sum(F.col("m") * to).alias("to"), F.sum(F.col("m") * back).alias("back"))
    both = both.select("lang", F.explode(F.array(F.struct("a", "b", F.col("to").alias("f")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("f")))).alias("x")).select("lang", "x.a", "x.b", "x.f")
    one = times.join(groups, "lang").select("lang", "m", "d", "none", F.element_at("place", F.col("source")).alias("a"), "n").withColumn("p", share(F.col("n"), F.get("d", "a")))
    one = one.select("lang", "m", "a", "p", F.get("none", "a").alias("o"), F.posexplode("none").alias("b", "q")).where("a <> b")
    less = gap(F.col("o"), F.col("q")), gap(F.col("q"), F.col("o"))
    ways = F.array(F.struct("a", "b", (gap(F.col("p"), F.col("q")) - less[0]).alias("f")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (gap(F.col("q"), F.col("p")) - less[1]).alias("f")))
    one = one.select("lang", "m", F.explode(ways).alias("x")).groupBy("lang", "x.a", "x.b").agg(F.sum(F.col("m") * F.col("x.f")).alias("f"))
    base = groups.select("lang", "v", "sources", "none", F.posexplode("d").alias("a", "da")).select("lang", "v", "sources", "none", "a", F.posexplode("sources").alias("b", "item")).where("a <> b")
    base = base.select("lang", "a", "b", F.get("sources", "a").alias("source"), "item", F.when(F.col("v") > 0, F.col("v") * gap(F.get("none", "a"), F.get("none", "b"))).otherwise(none).alias("f"))
    more = both.unionByName(one).groupBy("lang", "a", "b").agg(F.sum("f").alias("more"))
    pairs = base.join(more, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("f") + F.coalesce("more", none)).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", ranked)

    own = F.transform("w", lambda x: F.struct(x["a"].alias("a"), share(x["n"], F.get("d", x["a"])).alias("p")))
    above = wide.select("lang", F.col("term").alias("item"), share(F.col("total"), F.col("lang_d")).alias("lang_p"), own.alias("own"))
    above = above.select("lang", "item", "lang_p", F.explode(F.filter("own", lambda x: x["p"] > F.col("lang_p"))).alias("x"))
    above = above.select("lang", "x.a", "item", gap(F.col("x.p"), F.col("lang_p")).alias("value"))
    for by in (["lang", "a", "part"], ["lang", "a"]):
        parted = above.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
        above = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks).drop("part")
    terms = above.join(groups.select("lang", "sources"), "lang").select("lang", F.get("sources", "a").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(staged(spark, term_counts(table(spark, sf_dir, "documents")), "counts"))


QUERIES = {"op13_source_audit": op13_source_audit}
ORACLE_SQL = {
    "op13_source_audit": f"""
with d as (select row_number() over () as r, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by 1, 2 having count(distinct r) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
z as (select lang, count(*) as v, sum(total) as n from k group by 1),
gn as (select lang, source, coalesce(sum(n), 0) as n from g left join c using (lang, source) group by 1, 2),
gp as (select lang, source, term, coalesce(c.n, 0) as n, (1 + {UNIT}::hugeint * (coalesce(c.n, 0) + 1) // (gn.n + v)) as p from gn join k using (lang) join z using (lang) left join c using (lang, source, term)),
lp as (select lang, term, (1 + {UNIT}::hugeint * (total + 1) // (n + v)) as q from k join z using (lang)),
ps as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join ps on ps.lang = a.lang and ps.source = a.source and ps.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from gp join lp using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= {RANKS}"""
}
