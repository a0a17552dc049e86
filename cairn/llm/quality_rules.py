"""Quality rules by host: failures aggregated by domain, rates shrunk by an empirical beta prior, verdicts joined back.

Each text is measured alone (`measure`). A document fails the rules if it fails the base rule or one of the share rules below. A host's failure
rate has a beta posterior under a prior fitted to all hosts by moments. Its mean's odds, as a multiple of those of all documents (`host_odds`, within ODDS), are what the host
says of its documents: they scale the shares that these are judged by. So a document somewhat above a limit stays on a host that fails less often than others, and one
somewhat below goes on a host that fails more often; a host of the common rate leaves the limits as they are. A host whose rate is surely (its lower
credible bound, `z` deviations below the mean) above `host_bad` goes whole. Documents that fail the base rule go on every host.

Null and empty texts have no words, so they fail the base rule. Rows are judged one by one (equal rows get
equal rows back); a null host is a host of its own; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import staged, table

MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
#: limits of the share rules; deviations of the lower bound; the rate from which a host goes whole; what a host's odds may scale the limits by
SYMBOL_SHARE, DUP_LINE_SHARE, Z, HOST_BAD, ODDS = 0.2, 0.3, 1.28, 0.5, (0.5, 4.0)
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        out = {k: np.zeros(n, dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")}
        for lo, hi, buf, starts in T.blocks(b.column("text")):
            m = hi - lo
            inside = T.GRAPHIC[buf]
            s, e = T.spans(inside)
            doc = T.owner(starts, s)
            out["n_words"][lo:hi] = T.count_by(doc, m)
            out["word_chars"][lo:hi] = T.per_doc(inside & ((buf & 0xC0) != 0x80), starts)
            out["n_symbols"][lo:hi] = T.per_doc(SYMBOL[buf], starts)
            out["n_repeat_words"][lo:hi] = _repeats(T.hash_spans(buf, s, e), doc, m)
            line_end = np.flatnonzero(buf == T.SEP)
            line_start = np.concatenate(([0], line_end[:-1] + 1))
            worded = np.searchsorted(s, line_end) > np.searchsorted(s, line_start)
            line_start, line_end = line_start[worded], line_end[worded]
            line_doc = T.owner(starts, line_start)
            key = T.hash_spans(buf, line_start, line_end) + T.mix(line_doc.astype(np.uint64))
            _, first = np.unique(key, return_index=True)
            out["n_lines"][lo:hi] = T.count_by(line_doc, m)
            out["n_dup_lines"][lo:hi] = out["n_lines"][lo:hi] - T.count_by(line_doc[first], m)
        cols = [b.column("doc_id"), b.column("host"), *(pa.array(v) for v in out.values())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "host", *out])


def _repeats(word: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
    """Words of each document in 3-word windows that the document has twice or more."""
    if len(word) < 3:
        return np.zeros(m, dtype=np.int64)
    tri = T.mix(word[:-2] + T.mix(word[1:-1] + T.mix(word[2:] + doc[2:].astype(np.uint64))))
    own = np.flatnonzero(doc[:-2] == doc[2:])
    key = tri[own]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = own[twice]
    hit = np.zeros(len(word), dtype=bool)
    for k in range(3):
        hit[at + k] = True
    return T.count_by(doc[hit], m).astype(np.int64)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of each text, one row per row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measure, MEASURES)


def judge(measures: DataFrame, symbol_share: float = SYMBOL_SHARE, dup_line_share: float = DUP_LINE_SHARE, z: float = Z, host_bad: float = HOST_BAD, odds: tuple[float, float] = ODDS) -> DataFrame:
    """measures with base_failed, failed, host_rate (posterior mean), host_low (its lower bound), host_odds and kept; measures is read twice, so it should be a written table."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = lambda scale: (F.col("n_symbols") * scale > symbol_share * F.col("word_chars")) | (F.col("n_dup_lines") * scale > dup_line_share * F.col("n_lines"))
    m = measures.withColumn("base_failed", base).withColumn("failed", base | over(F.lit(1.0)))
    hosts = m.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("h_docs"), F.sum(F.col("failed").cast("long")).alias("h_failed"))
    rate = F.col("h_failed") / F.col("h_docs")
    got = hosts.agg(F.count("*").alias("k"), F.sum("h_docs").alias("n"), F.sum("h_failed").alias("f"), F.sum(F.col("h_docs") * rate * rate).alias("sq"), F.sum(F.col("h_docs") * F.col("h_docs")).cast("double").alias("nn")).first()
    alpha, beta = beta_prior(got["k"], got["n"] or 0, got["f"] or 0, got["sq"] or 0.0, got["nn"] or 0.0)
    size, mean = F.col("h_docs") + F.lit(alpha + beta), F.col("host_rate")
    hosts = hosts.withColumn("host_rate", (F.col("h_failed") + F.lit(alpha)) / size)
    times = mean / (1 - mean) / F.lit(alpha / beta)
    hosts = hosts.withColumn("host_low", F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (size + 1)))).withColumn("host_odds", F.least(F.greatest(times, F.lit(odds[0])), F.lit(odds[1])))
    hosts = hosts.select("h", "host_rate", "host_low", "host_odds")
    return m.join(hosts, m["host"].eqNullSafe(hosts["h"])).drop("h").withColumn("kept", ~F.col("base_failed") & ~over(F.col("host_odds")) & (F.col("host_low") <= host_bad))


def beta_prior(hosts: int, docs: int, failed: int, square: float, docs_sq: float) -> tuple[float, float]:
    """Alpha and beta by moments from document-weighted sums over hosts; where hosts agree as chance would, a prior worth 100 documents."""
    if not docs:
        return 1.0, 1.0
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    spread = square / docs - (failed / docs) ** 2
    chance = mean * (1 - mean) * max(hosts - 1, 0) / docs
    between = (spread - chance) / max(1 - docs_sq / docs**2 if hosts > 1 else 1, 1e-9)
    strength = mean * (1 - mean) / between - 1 if between > 0 else 100.0
    strength = min(max(strength, 1.0), 100.0)
    return mean * strength, (1 - mean) * strength


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(staged(spark, measure(table(spark, sf_dir, "documents")), "measures"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {
    "op7_quality_rules": f"""
with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
tri as (select r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] as s from (select r, w, unnest(generate_series(1, len(w) - 2)) as k from w where len(w) > 2)),
rep as (select r, count(distinct p) as n from (select r, unnest([k, k + 1, k + 2]) as p from (select r, k, count(*) over (partition by r, s) as c from tri) where c > 1) group by r),
m as (select doc_id, host, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join rep using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
f as (select *, base_failed or n_symbols > {SYMBOL_SHARE} * word_chars or n_dup_lines > {DUP_LINE_SHARE} * n_lines as failed from b),
h as (select host as h, count(*) as n, (count(*) filter (where failed))::double as f from f group by host),
s as (select count(*) as k, sum(n)::double as n, sum(f) as f, sum(n * (f / n) * (f / n)) as sq, sum(n * n)::double as nn from h),
s1 as (select *, least(greatest(f / n, 1e-6), 1 - 1e-6) as mean, sq / n - (f / n) * (f / n) as spread from s),
s2 as (select *, (spread - mean * (1 - mean) * (k - 1) / n) / greatest(case when k > 1 then 1 - nn / (n * n) else 1 end, 1e-9) as between_ from s1),
s3 as (select mean, least(greatest(case when between_ > 0 then mean * (1 - mean) / between_ - 1 else 100.0 end, 1.0), 100.0) as strength from s2),
q as (select h, n, (f + mean * strength) / (n + strength) as rate, strength, mean from h, s3),
v as (select h, rate, greatest(0.0, rate - {Z} * sqrt(rate * (1 - rate) / (n + strength + 1))) as low, least(greatest(rate / (1 - rate) / (mean * strength / ((1 - mean) * strength)), {ODDS[0]}), {ODDS[1]}) as odds from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not n_symbols * odds > {SYMBOL_SHARE} * word_chars and not n_dup_lines * odds > {DUP_LINE_SHARE} * n_lines and low <= {HOST_BAD} as kept, round(rate, 6) as host_rate
from f join v on f.host is not distinct from v.h"""
}
