"""The vector index and the inverted index against brute force, over clustered, random and copied rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators import postings as P
from cairn.operators import vector_index as I
from cairn.sources import staging

DIMS = 64


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>").repartition(3)


def signs(v):
    return (v @ V.projection(DIMS).T >= 0).astype(int)


def brute(v, limit, within=I.WITHIN, bar=None):
    """The rows that the search promises: near ones if they settle the query, else all."""
    bar = I.least_sure(within) if bar is None else bar
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm > 0, norm, 1)[:, None]
    s, out = signs(v), {}
    for q in range(0, len(v), 20):
        if norm[q] == 0:
            continue
        score = np.round(np.clip(unit @ unit[q], 0, 1), 12)
        near = (s != s[q]).sum(axis=1) <= within
        best = lambda ok: [j for j in np.lexsort((np.arange(len(v)), -score)) if ok[j] and score[j] > 0][:limit]  # noqa: E731, B023
        first = best(near)
        settled = len(first) == limit and score[first[-1]] >= bar
        out[q] = (first if settled else best(np.ones(len(v), bool)), settled)
    return out


def answers(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query"], []).append((-round(r["score"], 9), r["id"]))
    return {q: [i for _, i in sorted(x)] for q, x in out.items()}


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(3)
    base = r.normal(size=(40, DIMS))
    v = np.concatenate([base + 0.12 * r.normal(size=base.shape) for _ in range(15)])
    v[137] = v[100]
    v[7] = 0
    return v


def test_candidates_are_all_pairs_within_the_bits(spark, clustered):
    index = I.build(frame(spark, clustered), DIMS)
    ask = index.classes.where("cls % 20 = 0")
    got = {(r["query"], r["cls"]) for r in I.candidates(index, ask, dense=1.0).collect()}
    s = signs(clustered)
    alive = [i for i in range(len(clustered)) if i not in (7, 137)]
    want = {(q, j) for q in range(0, len(clustered), 20) if q in alive for j in alive if (s[q] != s[j]).sum() <= I.WITHIN}
    assert got == want and len(got) < 0.1 * 30 * len(clustered)
    assert index.buckets.count() == 4 * len(alive) and index.count == len(alive) and index.copies


def test_clusters_are_answered_from_buckets(spark, clustered):
    """Queries that their own cluster settles read their buckets alone, and find what brute force over all rows finds."""
    rows = frame(spark, clustered)
    index = I.build(rows, DIMS)
    want = brute(clustered, 5)
    assert sum(settled for _, settled in want.values()) > 0.9 * len(want)
    got = answers(I.nearest(index, rows.where("id % 20 = 0"), 5))
    assert got == {q: ids for q, (ids, _) in want.items()}
    exact = brute(clustered, 5, bar=2.0)
    hits = sum(len(set(got[q]) & set(ids)) for q, (ids, _) in exact.items())
    assert hits >= 0.95 * sum(len(ids) for ids, _ in exact.values())


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_random_vectors_are_asked_of_all(spark, dense):
    """No cluster settles them: recall is 1. The answer is the same whether buckets were read or not."""
    v = np.random.default_rng(5).normal(size=(300, DIMS))
    rows = frame(spark, v)
    got = answers(I.nearest(I.build(rows, DIMS), rows.where("id % 20 = 0"), 10, dense=dense))
    assert got == {q: ids for q, (ids, _) in brute(v, 10, bar=2.0).items()}


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_copies_meet_once(spark, clustered, dense):
    """A third of all rows is one vector: its class is asked once, and its ids come in order."""
    v = clustered.copy()
    v[100:300] = v[100]
    rows = frame(spark, v).withColumn("n", F.lit(1)).withColumn("cls", F.lit(2))
    index = I.build(rows.select("id", "v"), DIMS)
    assert index.classes.where("n > 1").count() == 1
    got = answers(I.nearest(index, rows.select("id", "v").where("id % 20 = 0"), 10, dense=dense))
    assert got == {q: ids for q, (ids, _) in brute(v, 10).items()} and got[120] == list(range(100, 110))


def test_more_queries_than_one_scan_takes(spark, monkeypatch):
    v = np.random.default_rng(6).normal(size=(200, DIMS))
    rows = frame(spark, v)
    monkeypatch.setattr(I, "PASS_BYTES", 4 * DIMS * 8)
    got = answers(I.nearest(I.build(rows, DIMS), rows.where("id % 20 = 0"), 3))
    assert got == {q: ids for q, (ids, _) in brute(v, 3, bar=2.0).items()}


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(0, None), (20, [1.0, 2.0]), (40, [float("nan")] * DIMS), (60, [0.0] * DIMS), (80, [1.0] * DIMS), (81, [-1.0] * DIMS), (82, [float("inf")] * DIMS)], "id long, v array<double>")
    assert answers(I.nearest(I.build(rows, DIMS), rows.where("id % 20 = 0"), 10)) == {80: [80]}
    none = rows.limit(0)
    assert I.nearest(I.build(none, DIMS), none, 10).count() == 0


def test_chance_of_the_bar():
    assert I.least_sure(12) == pytest.approx(0.906261, abs=1e-5) and len(I.flips(3)) == 697 and I.flips(0).tolist() == [0]


WORDS = ["the", "tion", "tional", "tea", "ünï", "Привет", "x1", *(f"w{i}" for i in range(40))]


@pytest.fixture(scope="module")
def written(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(WORDS[:7] if r.random() < 0.4 else WORDS) for _ in range(r.choice((0, 1, 5, 30, 120))))) for i in range(700)]
    rows += [(1000 + i, "the the tion copy") for i in range(300)]  # copies: equal scores, a common term, several blocks
    rows += [(2000, None), (2001, ""), (2002, " .,;! "), (2003, "The-TION/tea_x1 ПРИВЕТ"), (2004, "rare " + "filler " * 400)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("term", F.lit("x")).repartition(4)
    return rows, P.build(docs)


def terms_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(str.maketrans(P.L.UPPER, P.L.LOWER)))


def scores(rows, asked):
    """All documents by BM25, by hand."""
    own = {i: collections.Counter(terms_of(t)) for i, t in rows}
    mean, n = sum(c.total() for c in own.values()) / len(own), len(own)
    out = {}
    for t in set(asked):
        df = sum(t in c for c in own.values())
        for i, c in own.items():
            if c[t]:
                w = c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean))
                out[i] = out.get(i, 0.0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * w
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_blocks_hold_all_postings_in_order(written):
    rows, index = written
    got = collections.defaultdict(dict)
    for r in index.blocks.collect():
        assert 0 < r["n"] == len(r["ids"]) <= P.BLOCK and r["bound"] >= r["low"]
        for i, tf, length in zip(r["ids"], r["tfs"], r["lengths"], strict=True):
            assert i not in got[r["term"]]
            got[r["term"]][i] = (tf, length)
    want = collections.defaultdict(dict)
    for i, t in rows:
        c = collections.Counter(terms_of(t))
        for term, n in c.items():
            want[term][i] = (n, c.total())
    assert got == want
    for r in index.terms.collect():
        weights = sorted((n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / index.mean)) for n, length in want[r["term"]].values()), reverse=True)
        assert r["df"] == len(weights) and r["top"] == pytest.approx(weights[0])
        for k in P.LADDER:  # a weight that k postings reach at least, where it is known
            assert r[f"reach{k}"] is None or weights[k - 1] >= r[f"reach{k}"] - 1e-12
            assert len(weights) >= k or r[f"reach{k}"] is None


@pytest.mark.parametrize("limit", [1, 10, 60, 2000])
def test_bm25_is_that_of_all_documents(spark, written, limit):
    rows, index = written
    queries = {0: ["the", "tion", "rare"], 1: ["the"], 2: ["w3", "w4", "the", "tea", "absent"], 3: ["absent"], 4: ["ünï", "привет", "x1", "the", "tion", "w1", "w2"], 5: ["copy", "tion"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in [*ts, ts[0]]], "query long, term string")
    got = collections.defaultdict(list)
    for r in P.bm25(index, asked, limit).orderBy("query", F.desc("score"), "id").collect():
        got[r["query"]].append((r["id"], r["score"]))
    for q, ts in queries.items():
        want = scores(rows, ts)[:limit]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-8)


def test_bm25_leaves_blocks_unread(spark, written):
    """A rare term decides: the common term's documents are not even candidates."""
    rows, index = written
    asked = spark.createDataFrame([(0, "copy"), (0, "the")], "query long, term string")
    plan = P.bm25(index, asked, 10)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "text" not in plan
    own = {r["term"]: r for r in index.terms.where("term in ('copy', 'the')").collect()}
    idf = lambda t: math.log((index.docs - own[t]["df"] + 0.5) / (own[t]["df"] + 0.5) + 1)
    assert idf("the") * own["the"]["top"] < idf("copy") * own["copy"]["reach10"]  # so the common term is not read
    assert [r["id"] for r in P.bm25(index, asked, 10).orderBy(F.desc("score"), "id").collect()] == [i for i, _ in scores(rows, ["copy", "the"])[:10]]


def test_prefixes(spark, written):
    rows, index = written
    queries = {0: ["tion", "te"], 1: ["t"], 2: ["w1", "w1"], 3: ["zzz", ""], 4: ["при", "x"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query long, token string")
    got = {(r["query"], r["id"]): r["score"] for r in P.keyword_scores(index, asked).collect()}
    want = {}
    for q, ts in queries.items():
        for i, text in rows:
            n = sum(any(x.startswith(t) for x in terms_of(text)) for t in set(ts) if t)
            want |= {(q, i): n} if n else {}
    assert got == want
    exact = {(r["query"], r["id"]) for r in P.keyword_scores(index, asked, prefix=False).collect()}
    assert exact == {(q, i) for q, ts in queries.items() for i, text in rows if set(ts) & set(terms_of(text))}


def test_query_terms(spark):
    row = spark.createDataFrame([("What is the TION of tion, Привет-Café x1?",), (None,)], "q string").select(P.query_terms(F.col("q"))).collect()
    assert [r[0] for r in row] == [["tion", "привет", "café", "x1"], []]


def test_an_empty_index(spark):
    index = P.build(spark.createDataFrame([], "id long, text string"))
    assert index.docs == 0 and not P.bm25(index, spark.createDataFrame([(0, "a")], "query long, term string"), 5).collect()
    assert not P.keyword_scores(index, spark.createDataFrame([(0, "a")], "query long, token string")).collect()


def test_indexes_are_kept_for_the_same_files(spark, tmp_path):
    built = []
    make = lambda: built.append(1) or staging.staged(spark, spark.range(3), "x")
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    with staging.scope(spark):
        first = staging.kept_index(spark, "k", [path], make)
    assert staging.kept_index(spark, "k", [path], make) is first and first.count() == 3 and len(built) == 1
    assert staging.kept_index(spark, "other", [path], make) is not first
    spark.range(4).write.mode("append").parquet(path)
    staging.kept_index(spark, "k", [path], make)
    assert len(built) == 3
