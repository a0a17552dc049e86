"""Literal cases: fusion, decay, diversification, scores, permissions, lines, hygiene, chunks, redaction, streams."""

import time

import pytest
from pyspark.sql import functions as F

from cairn.functions import access as A
from cairn.functions import graphs as G
from cairn.functions import lexical as L
from cairn.functions import lifecycle as C
from cairn.functions import texts as X
from cairn.functions import vectors as V
from cairn.operators import greedy
from cairn.plans import search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def items(spark, rows):
    return spark.createDataFrame([(i, s, c, t) for i, s, c, t in rows], "id string, score double, confidence double, created_at_ms long")


def test_rrf(spark):
    a = items(spark, [("a", 10.0, 0.2, 10), ("b", 9.0, 0.5, 0)])
    b = items(spark, [("c", 10.0, 0.5, 0), ("a", 9.0, 0.9, 20)])
    got = {r["id"]: r for r in search.fuse([a, b]).collect()}
    assert max(got, key=lambda k: got[k]["rrf"]) == "a"
    assert (got["a"]["created_at_ms"], got["a"]["confidence"]) == (20, 0.9)
    again = {r["id"]: r["rrf"] for r in search.fuse([b, a]).collect()}
    assert again == {k: r["rrf"] for k, r in got.items()}


def test_decay(spark):
    day = 86_400_000
    at = lambda created, now, half=7.0: one(spark, L.temporal_decay(F.lit(1.0), F.lit(created), F.lit(now), half))
    assert at(day, 15 * day) == pytest.approx(0.25)
    assert at(0, 1000) == at(-1, 1000) == at(2000, 1000) == 1.0


@pytest.mark.parametrize("balance, score, want", [(0.5, 0.8, ["a", "c"]), (1.0, 0.2, ["a", "b"]), (0.5, 0.2, ["a", "c"])])
def test_mmr(spark, balance, score, want):
    c = spark.createDataFrame([(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.99, [1.0, 0.0]), (1, "c", score, [0.0, 1.0])], "q int, id string, score double, embedding array<double>")
    got = [r["id"] for r in greedy.mmr(c, [1.0, 0.0], 2, balance).orderBy("place").collect()]
    assert got == want


@pytest.mark.parametrize("query, text, want", [("??? OR AND the", "the and or", 0), ("decision decision OR what", "ADR decision rationale", 1), ("scope:project/Harbour", "project harbour docs", 2), ("почему решение", "РЕШЕНИЕ принято", 1)])
def test_lexical(spark, query, text, want):
    assert one(spark, L.score(query, F.lit(text))) == want


@pytest.mark.parametrize("query, want", [("src/memory/root.zig", "keyword_only"), ("how does the central memory retrieval system select context", "vector_only"), ("central memory", "keyword_only"), ("the central memory keeps records", "hybrid")])
def test_strategy(spark, query, want):
    assert one(spark, L.strategy(F.lit(query))) == want == L.plan(query, adaptive=True).strategy


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert [one(spark, V.cosine(v(1, 0, 0), w)) for w in (v(1, 0, 0), v(0, 1, 0), v(0, 0))] == [1.0, 0.0, 0.0]


def test_permissions(spark):
    me = A.Actor("a", ("project:harbour", "session:*"))
    see = lambda s: one(spark, A.scope_visible(F.lit(s), me))
    assert [see("project:har"), see("session:sess_1"), see("public"), see("project:harbour")] == [False, True, True, True]
    perms = F.array(F.lit("team:platform"))
    assert [one(spark, A.record_visible(F.lit("public"), perms, x)) for x in (A.Actor("a", ("team:platform",)), A.Actor("a"))] == [True, False]
    both = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, A.scope_list_visible(both, A.Actor("a", ("x",)))) is False
    assert one(spark, A.scope_list_visible(F.array().cast("array<string>"), A.Actor("a"))) is False
    assert one(spark, A.permissions_visible(F.lit(None).cast("array<string>"), A.Actor("a"))) is False


@pytest.mark.parametrize("line, want", [("Decision: x", "decision"), ("- Risk: x", "risk"), ("[00:01:04] Alice: Decision: x", "decision"), ("Root cause: x", "root_cause"), ("Alice: we decided to go", "decision"), ("Assignee: x", "owner"), ("Acceptance criteria: x", "requirement"), ("PR: x", "related_pr"), ("plain words", None)])
def test_atoms(spark, line, want):
    got = one(spark, X.atom(X.cleaned_line(F.lit(line))))
    assert (got and got["predicate"]) == want


@pytest.mark.parametrize("line, want", [("Gate depends on Harbour", "depends_on"), ("Relation: WORK-42 -> implements -> ADR-7", "implements"), ("Decision: a -> b", None), ("ab -> cd", "related_to")])
def test_relations(spark, line, want):
    got = X.relations(spark.createDataFrame([(line,)], "line string")).first()
    assert (got and got["relation"]["type"]) == want


def test_hygiene(spark):
    day = C.DAY
    act = lambda s, v, n: one(spark, C.hygiene(F.lit(s), F.lit(v).cast("long"), F.lit(n), 7, 30, 90))
    assert [act("verified", 0, 8 * day), act("deprecated", 0, 1), act("verified", 0, 100 * day), act("verified", 5, 1), act("verified", None, 900 * day)] == ["mark_stale", "archive", "purge", "keep", "keep"]
    fresh = lambda now, ttl: one(spark, C.fresh(F.lit(100), F.lit(ttl), F.lit(now)))
    assert [fresh(150, 50), fresh(151, 50), fresh(10**9, 0)] == [True, False, True]


def test_framing(spark):
    assert one(spark, X.framed_sha256(F.lit("ab"), F.lit("c"))) != one(spark, X.framed_sha256(F.lit("a"), F.lit("bc")))


def test_graph(spark):
    e = G.neighbours(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "from_id string, to_id string"))
    assert {(r["id"], r["hops"]) for r in G.traverse(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert G.shortest_path(e, "a", "d", 5).first()["path"] == ["a", "c", "d"]
    assert G.shortest_path(e, "a", "zz", 5).count() == 0
    assert one(spark, G.valid(F.lit("fixed"), F.lit("pr"), F.lit("bug"))) is True
    assert one(spark, G.valid(F.lit("owns"), F.lit("api"), F.lit("team"))) is False


def test_chunks():
    text = "# One\n" + "word " * 500 + "\n# Two\n" + "überall " * 300
    got = X.chunk_text(text)
    raw = text.encode()
    assert got[0][0] == 0 and got[-1][1] == len(raw) and all(b - a <= 1800 for a, b, _ in got)
    assert all(x[1] >= y[0] for x, y in zip(got, got[1:], strict=False)) and any(raw[a:].startswith(b"# Two") and p == "Two" for a, _, p in got)
    assert all(raw[a:b].decode() for a, b, _ in got) and X.chunk_text("") == []


def test_long_texts_take_time_in_proportion(spark):
    """Headings and runs by the hundred thousand: linear work, where a second walk for each would take hours."""
    began = time.time()
    headed = "".join(f"# h{i}\ntext {i}\n" for i in range(100_000))
    got = X.chunk_text(headed)
    assert len(got) > 90_000 and got[0][0] == 0 and got[-1][1] == len(headed) and time.time() - began < 5
    for t in ("a." * 500_000, "a." * 500_000 + "@", "@a." * 300_000, "+1(" * 300_000, "x " * 300_000):
        began = time.time()
        X.redact(t)
        assert time.time() - began < 5, t[:10]
    assert X.redact("." * 100_000 + "a@b.org") == "." * 100_000 + "[EMAIL_1]"
    began = time.time()
    rows = spark.createDataFrame([("a." * 200_000 + " c@d.org_e@f.org",)], "text string").select(F.regexp_count("text", F.lit(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")))
    assert rows.first()[0] == 2 and time.time() - began < 10


def test_redaction():
    assert X.redact("mail a@b.org or a@b.org, c@d.org") == "mail [EMAIL_1] or [EMAIL_1], [EMAIL_2]"
    assert X.redact("4111 1111 1111 1111 and 4111 1111 1111 1112") == "[CARD_1] and 4111 1111 1111 1112"
    assert X.redact("api_key=abc Bearer xyz") == "[SECRET_1] [TOKEN_1]"


def test_formats(spark, tmp_path):
    from cairn.sources import formats as S

    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("---\ntype: decision\n---\n# Title\nbody")
    (tmp_path / "md" / "b.md").write_text("no heading")
    got = {r["file"]: (r["type"], r["title"], r["status"]) for r in S.read_markdown(spark, str(tmp_path / "md")).collect()}
    assert got == {"a.md": ("decision", "Title", "proposed"), "b.md": ("page", "b", "draft")}
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    S.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, S.read_jsonl(spark, str(tmp_path / "j"), "id long, v string").select("id", "v").collect())) == [(1, "x"), (2, None)]
    S.write_markdown(spark.createDataFrame([("d1", "decision", "Head", "accepted", "one\ntwo")], "id string, type string, title string, status string, text string"), str(tmp_path / "out"))
    (page,) = [r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()]
    assert page.strip() == "---\nid: d1\ntype: decision\nstatus: accepted\n---\n# Head\none\ntwo"
    old = spark.createDataFrame([("k1", "text", "core", None, 5), (" ", "x", "core", None, 5), ("k2", "y" * 50, "core", "s", 6)], "key string, content string, category string, session_id string, created_at long")
    assert [(r["created_at_ms"], r["refused"]) for r in S.legacy_records(old, "memories", 20).collect()] == [(5000, None), (5000, "no key"), (6000, "too long")]
    assert S.legacy_records(spark.createDataFrame([("a", "b")], "key string, value string"), "kv").first().asDict() == {"key": "a", "content": "b", "category": "kv", "refused": None}
    S.append_missing(spark, df, str(tmp_path / "t"), ("id",))
    S.append_missing(spark, df.unionByName(spark.createDataFrame([(3, "z")], "id long, v string")), str(tmp_path / "t"), ("id",))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_stream_export(spark, tmp_path):
    from cairn.streaming import feed_stream as FS

    out = str(tmp_path / "export")
    for point in ("a", "a", "b"):  # goes on, and replays from the start
        FS.export(spark, FS.feed(spark, "/root/testdata/sf0.001/events.parque[t]"), out, str(tmp_path / point))
    assert spark.read.parquet(out).count() == 1000


def test_codecs(spark):
    from cairn.functions import codecs as K

    assert [K.trimmed("über alles", n) for n in (20, 6, 5, 4, 2, 0)] == ["über alles", "üb...", "ü...", "...", "..", ""]
    assert all(len(K.trimmed("ü" * 9, n).encode()) <= n for n in range(19))
    row = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": 3}}', [1.0, -2.5])], "j string, v array<float>")
    got = row.select(K.canonical_json("j").alias("j"), K.bytes_to_vector(K.vector_to_bytes("v")).alias("v"), K.trim_utf8("j", 5).alias("t")).first()
    assert (got["j"], got["v"], got["t"]) == ('{"a":{"c":3,"d":2},"b":1}', [1.0, -2.5], '{"...')


def test_sinks(spark, tmp_path):
    from cairn.streaming import sinks

    relations = spark.createDataFrame([("a", "owns", "b"), ("a", "owns", "b"), ("c", "uses", "d")], "from_id string, type string, to_id string")
    out = str(tmp_path)

    def send(rows):
        import uuid

        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(r["key"] for r in rows))

    sinks.write_batch(sinks.graph_upserts(relations), send, 1)
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["a|owns|b", "c|uses|d"]
    chunk = spark.createDataFrame([("source", "s1", 2, "t", [0.5])], "object_type string, object_id string, ordinal int, text string, embedding array<float>")
    assert sinks.vector_upserts(chunk).first()["key"] == "vec:6:source:s1:2"
    assert [r["op"] for r in sinks.graph_deletions(relations).collect()] == ["delete"] * 3 and sinks.resets(spark.createDataFrame([("a",)], "namespace string")).first()["key"] == "ns:a"


def test_identifiers():
    assert L.identifier_expansion("WORK-42") == (["ticket"], ["work-42", "ticket", "issue", "task"])
    assert L.identifier_expansion("see HTTPServer2, team:searchIndex") == (["entity_lookup", "scoped_lookup"], ["http", "server", "team", "search", "index"])
    assert L.identifier_expansion("src/main") == (["repository"], ["repo", "repository", "src", "main"]) and L.identifier_expansion("plain words") == ([], [])
    assert L.normalized_terms(["(Ab)", "aB", "x", "y" * 81]) == ["ab"] and len(L.normalized_terms([f"t{i}" for i in range(100)])) == 64


def test_windows():
    assert L.Windows(50).candidates == 200 and L.Windows(50, use_mmr=False).candidates == 50 and L.Windows(0).candidates == 0 == L.Windows(0).reranked
    assert L.Windows(10, 990).candidates == 1000 and L.Windows(5, use_mmr=False, rerank=True).candidates == 24 and L.Windows(600).page == 500
    assert L.Windows(10, 0).reranked == 24 and L.Windows(10, 100).reranked == 110 and L.saturated(1 << 62, 8) == (1 << 63) - 1


def test_token_signature(spark):
    one_ = V.token_signature_of("alpha alpha", "beta")
    assert sum(map(abs, one_)) in (1, 3) and V.token_signature_of("ALPHA Alpha beta") == one_ and V.token_signature_of("") == [0] * 32
    rows = spark.createDataFrame([("alpha alpha", "beta"), (None, "")], "a string, b string")
    assert [r["signature"] for r in V.token_signatures(rows, ["a", "b"]).collect()] == [one_, [0] * 32]


def test_reduced_objects(spark, tmp_path):
    """Patches folded one by one give what the last writes of leaves give, values and objects replacing each other too."""
    import json

    from cairn.plans import feed

    patches = [{"k": 1, "o": {"a": 1, "b": {"c": 1}}}, {"o": {"b": 5}}, {"o": {"b": {"d": 2}}, "k": {}}, {"k": {"z": None}}, {"o": {"a": [1, {"x": 2}]}}, {"k": 7}]
    rows = [(1 + 7 * i, 50, "view", 0.0, json.dumps(p), i) for i, p in enumerate(patches)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, i int")
    made.select("event_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, i, 0)").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")

    def merge(a, b):
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    want: dict = {}
    for r in rows:
        want = merge(want, json.loads(r[4]) | {"last": {f"n{r[0] % 3}": r[0]}})
    assert [json.loads(r["state"]) for r in feed.agent_memory_reduce(spark, str(tmp_path)).collect()] == [want]


def test_diversified_search(spark):
    """The greedy choices by hand: score less overlap and repeated types; every twentieth of the search's page is still found."""
    rows = [("a", 1.0, "one two three", "x"), ("b", 0.9, "one two three", "x"), ("c", 0.7, "other words here", "x"), ("d", 0.69, "quite new text", "y")]
    c = spark.createDataFrame([(1, *r) for r in rows], "q int, id string, score double, text string, type string")
    got = [(r["id"], r["adjusted"]) for r in greedy.diversify(c, 4).orderBy("place").collect()]
    left, taken, want = list(rows), [], []
    while left:
        value = lambda r: r[1] - 0.35 * max((sum(w in t[2] for w in r[2].split()) / 3 for t in taken), default=0.0) - 0.03 * sum(t[3] == r[3] for t in taken)
        pick = max(left, key=value)
        want.append((pick[0], pytest.approx(value(pick))))
        left.remove(pick)
        taken.append(pick)
    assert got == want
    page = search.search_diversified(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["place"] for r in page) == list(range(1, len(page) + 1)) and len(page) == min(50, search.finalized(spark, "/root/testdata/sf0.001").count())
    assert {r["id"] for r in search.search_diversified(spark, "/root/testdata/sf0.001", "remote").collect()} <= {r["id"] for r in search.finalized(spark, "/root/testdata/sf0.001").collect()}


def test_transcript_chunks():
    text = "# Call\n[00:01] Ann: hello\n" + "word " * 500 + "\n[00:02] Bob: end"
    assert [p for _, _, p in X.chunk_text(text)][0] == "Call > timestamp:00:01 > speaker:Ann"


def test_hash_embedding(spark):
    import math
    import zlib
    from collections import Counter

    from cairn.plans import vectors as P

    texts = {f"src_{r['doc_id']}": r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in P.hash_embedding(spark, "/root/testdata/sf0.001").collect():
        c = Counter(zlib.crc32(w.encode()) % 64 for w in texts[r["id"]].lower().split())
        n = math.sqrt(sum(v * v for v in c.values()))
        assert r["dims"] == 64 and r["top"] == pytest.approx(max(c.values()) / n if n else 0.0, abs=1e-6)


def test_associative_search(spark):
    """Candidates, lexical score, trust and signatures by hand."""
    import math
    import re

    d = "/root/testdata/sf0.001"
    asked = {w.lower() for w in re.findall("[A-Za-z0-9_]+", search.QUERY)}
    words, query, want = L.tokens(search.QUERY), V.token_signature_of(search.QUERY), []
    for r in search.memories(spark, d).collect():
        content = r["content"]
        if not asked & set(re.findall("[a-z0-9_]+", content.lower())):
            continue
        lex = sum((w in r["key"].lower()) + (w in content.lower()) for w in words)
        own = V.token_signature_of(r["key"], content)
        norm = math.sqrt(sum(x * x for x in own) * sum(x * x for x in query))
        cos = min(1.0, max(0.0, sum(a * b for a, b in zip(own, query, strict=True)) / norm)) if norm else 0.0
        want.append((round(lex + 0.5 + 0.05 * r["v"] + 0.5 * cos, 6), r["created_at_ms"], r["key"], r["session_id"]))
    want = sorted(want, key=lambda x: (-x[0], -x[1], x[2], x[3]))[:100]
    got = [(r["score"], r["key"], r["session_id"]) for r in search.holographic_search(spark, d).collect()]
    assert len(got) == len(want) and sorted(got) == [(pytest.approx(s), k, i) for s, _, k, i in sorted(want, key=lambda x: (x[0], x[2], x[3]))]
