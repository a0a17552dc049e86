"""Replies of rankers, identifiers and summaries: column expressions against literal cases and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import lexical as L
from cairn.plans import replies as R

SF = "/root/testdata/sf0.001"
IDS = ["a", "src_12", "x-9", "7", "b"]


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("2, 1, 2, 9, 0, 5", [2, 1, 5, 3, 4]), ('["src_12", "b"]', [2, 5, 1, 3, 4]), ('{"ranking": [3, 1], "score": 4}', [3, 1, 2, 4, 5]), ("I think x-9 is best; then (b).", [3, 5, 1, 2, 4]),
        ('[{"id":"b","score":0.9},{"id":"a","sco', [5, 1, 2, 3, 4]), ("", [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5]), ("nothing of use", [1, 2, 3, 4, 5]), ("- `src_12`\n- *4*\n# 1", [2, 4, 1, 3, 5]), ("99999999999999999999 -1 1.5 3.", [3, 1, 2, 4, 5]),
        ("unknown src_13 SRC_12", [1, 2, 3, 4, 5]), ('{"reason": "src_12 and b", "ids": ["a"]}', [1, 2, 3, 4, 5]),
    ],
)
def test_ranking(spark, reply, want):
    df = spark.createDataFrame([(reply, IDS)], "reply string, ids array<string>")
    assert df.select(R.ranking(F.col("reply"), F.col("ids"))).first()[0] == want


def test_ranking_of_no_candidates(spark):
    df = spark.createDataFrame([("1 2 a", [])], "reply string, ids array<string>")
    assert df.select(R.ranking(F.col("reply"), F.col("ids"))).first()[0] == []


def test_identifiers_are_those_of_the_scanner(spark):
    """The expressions give what the scanner of one query gives, for random texts of every kind of token."""
    r = random.Random(8)
    pieces = ["WORK-42", "ab-1x", "MemoryStore", "HTTPServer2", "API", "ABCDEFGHIJKLMNOP", "team:searchIndex", ":x", "y:", "a:b:cD", "src/main/X", "/", "//a", "plain", "x", "don't", "ÜberKlasse", "a1b2C3", "(Foo/barBaz)", "T-1", "#1", "Zz:", "k8s/Pod7"]
    texts = [" ".join(r.choice(pieces) + r.choice(["", ",", ".", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    intents, terms = L.identifier_terms(F.col("q"))
    for q, i, t in spark.createDataFrame([(q,) for q in texts], "q string").select("q", intents, terms).collect():
        assert (i, t) == L.identifier_expansion(q), q


def test_saturation(spark):
    most = (1 << 63) - 1
    rows = [(0, 5), (3, 1 << 62), (2, 1 << 62), (1, most), (None, 2)]
    got = spark.createDataFrame(rows, "n long, f long").select(L.saturated_product(F.col("n"), F.col("f")).alias("x")).collect()
    assert [x["x"] for x in got] == [0, most, most, most, None]


def test_summaries(spark):
    """Sections hold the first items in order, JSON is JSON, and the quality is that of the items."""
    items = {}
    for x in sorted(map(tuple, R._items(spark, SF).collect())):
        items.setdefault(x[0], []).append(x)
    rows = R.session_summary(spark, SF).collect()
    assert {x["session_id"] for x in rows} == set(items)
    for x in rows:
        own, quality = json.loads(x["sections"]), json.loads(x["quality"])
        assert list(own) == R._NAMES
        for k in R._NAMES:
            want = [{"text": i[4], "message_index": i[1], "role": i[5]} for i in items[x["session_id"]] if i[3] == k][: R.CAP]
            assert own[k] == want
        n = sum(map(len, own.values()))
        assert quality["item_count"] == n and quality["truncated"] == (len(items[x["session_id"]]) > n) and quality["citation_coverage"] == 100
    coverage = {x["session_id"]: x["coverage"] for x in R.citation_coverage(spark, SF).collect()}
    for s, own in items.items():
        messages = json.loads(next(x["quality"] for x in rows if x["session_id"] == s))["message_count"]
        kept = [i for k in R._NAMES for i in [i for i in own if i[3] == k][: R.CAP]]
        assert coverage[s] == 100 * sum(i[1] + 2 <= messages for i in kept) // len(kept)
    assert len(set(coverage.values())) > 1
