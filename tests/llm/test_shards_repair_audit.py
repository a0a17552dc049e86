"""Token shards, conversation repair and the source audit: against whole-text encoding, exhaustive search and plain counting."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import repair as R
from cairn.llm import source_audit as A
from cairn.llm import textops as T
from cairn.llm import token_shards as S
from cairn.llm.wavelet import Wavelet, build

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(S.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    import public_tokenizers

    with open(public_tokenizers.path(S.VOCABULARY), "rb") as f:
        return S.Encoder(f.read())


def encoded(e, texts):
    out = []
    for lo, hi, raw, starts in T.blocks(pa.array(texts)):
        ids, n = e.block(raw, starts)
        cut = np.concatenate(([0], np.cumsum(n)))
        out += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def test_encoder_gives_the_ids_of_whole_texts(tokenizer, own):
    r = random.Random(5)
    signs = "abcXYZ019 .,'|<>-_\t\n\r\x0b\x1c\x85éÉ×÷ß́ дЖ日😀ª²　"
    texts = ["don't I'LL 'tis", "<|endoftext|> a<|ENDOFTEXT|>b", "naïve Café ÀÉÎ×÷µ ªº²", "é à ,́x", "日本語 text 12a3", "ſtraße İstanbul Σίσυφος", "x" * 2000, "", " \n ", "'s't're", None]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for _ in range(2):  # the second time from what it keeps
        assert encoded(own, texts) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_keeps_a_bounded_number_of_pieces(tokenizer, own, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 50)
    monkeypatch.setattr(own, "_old", {})
    monkeypatch.setattr(own, "_young", {})
    texts = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]} {i}" for i in range(600)]
    for k in range(0, 600, 20):
        assert encoded(own, texts[k : k + 20]) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k : k + 20]]
        assert len(own._young) <= 50 + 100 and len(own._old) <= 50 + 100


def test_pieces_are_found_as_in_a_dict():
    r = np.random.default_rng(3)
    pool = np.concatenate((r.integers(0, 1 << 63, 4000, dtype=np.uint64), np.arange(5, dtype=np.uint64)))
    held, want = S.Pieces(), {}
    for k in range(40):
        keys = np.unique(r.choice(pool, 150))
        keys = keys[held.find(keys) < 0]
        r.shuffle(keys)
        size, kept = r.integers(1, 5, len(keys)), len(keys) - k % 4 if len(keys) > 3 else len(keys)
        ids = r.integers(0, 49_406, int(size.sum())).astype(np.uint32)
        held.add(keys, size, ids, kept)
        cut = np.concatenate(([0], np.cumsum(size)))
        each = [ids[x:y].tolist() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        n, got = held.ids(len(want) + np.arange(len(keys)))  # those that do not stay can be read too
        assert n.tolist() == size.tolist() and got.tolist() == ids.tolist()
        want |= dict(zip(keys[:kept].tolist(), each[:kept], strict=True))
        row = held.find(pool)
        assert len(held) == len(want) and [x >= 0 for x in row.tolist()] == [x in want for x in pool.tolist()]
        assert held.ids(row[row >= 0])[1].tolist() == [i for x in pool.tolist() for i in want.get(x, [])]


def test_encoder_takes_long_pieces_beside_kept_ones(tokenizer, own, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 8)
    monkeypatch.setattr(own, "_old", {})
    monkeypatch.setattr(own, "_young", {})
    long = ["ab" * 33, "é" * 32 + "x", "q|" * 40, "日本" * 30, "=-" * 70, "Σ" + "y" * 64]
    for k in range(12):
        texts = [f"{long[k % 6]} the {'abcdef'[k % 6]}q {long[(k + 1) % 6]}", f"{long[k % 6]}{k}", "", f"the 'tis {'klm'[k % 3] * 3}", long[k % 6].upper()]
        assert encoded(own, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own._young) <= 8 + 12 and len(own._old) <= 8 + 12


def test_encoder_gives_new_plain_pieces_to_the_model_without_the_pattern(tokenizer, own, monkeypatch):
    monkeypatch.setattr(own, "_old", {})
    monkeypatch.setattr(own, "_young", {})
    full, seen = own._tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **kind):
            seen.extend(texts)
            return full.encode_batch_fast(texts, **kind)

    monkeypatch.setattr(own, "_tokenizer", Watched())
    texts = ["Été, naïve Straße 2024!", "don't Übung's", "été 日本 x"]
    assert encoded(own, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(seen) == ["don't", "Übung's", "日本"]


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (5, 2), (70_000, 1), (140_000, 3), (200_000, 3000)])
def test_wavelet(n, kinds):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % kinds * 7 + 3).astype(np.uint32)
    data = build(ids, np.array([n // 3, n - n // 3]), np.array([4, 0]), np.array([False, True]))
    reads = []

    def read(at, size):
        reads.append(size)
        return data[at : at + size]

    w = Wavelet(read, len(data))
    assert w.docs[0] == 4 and w.null.tolist() == [False, True] and w.starts.tolist() == [0, n // 3, n]
    for i in r.integers(0, n, 12).tolist() if n else []:
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        lo, hi = sorted(r.integers(0, n + 1, 2).tolist())
        inner = places[(places >= lo) & (places < hi)]
        assert w.access(i) == token and w.count(token) == len(places) and w.select(token, len(places) // 2) == places[len(places) // 2]
        assert w.occurrences(token).tolist() == places.tolist() and w.occurrences(token, lo, hi).tolist() == inner.tolist() and w.count(token, lo, hi) == len(inner)
    assert w.count(2) == 0 and not len(w.occurrences(2)) and w.ids().tolist() == ids.tolist()
    if kinds == 3000:
        reads.clear()
        fresh = Wavelet(read, len(data))
        assert fresh.access(7) == ids[7] and sum(reads) < len(data) / 2  # a question reads its blocks alone
    with pytest.raises(ValueError):
        Wavelet.of(data[:-3])


def test_shards(spark, tokenizer, tmp_path):
    rows = [(9, "The cat. The end"), (None, "null id"), (3, None), (3, ""), (3, "b"), (3, "b"), (-4, "x" * 500), (12, "ünï don't")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)
    files = S.shards(docs, f"file://{tmp_path}/shards", shard=6)
    assert files.count() > 1 and len(list((tmp_path / "shards").iterdir())) == files.count()
    got = sorted(map(tuple, S.read_documents(files).collect()), key=lambda x: x[1])
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    assert [x[0] for x in got] == [None, -4, 3, 3, 3, 3, 9, 12]
    start, everything = 0, []
    for i, at, n, crc in got:
        own = next(x for x in ids[i] if zlib.crc32(np.array(x, "<u4").tobytes()) == crc and len(x) == n)
        ids[i].remove(own)
        assert at == start
        start, everything = start + n, everything + own
    token = everything[1]
    assert sorted(x["at"] for x in S.find_token(files, token).collect()) == [k for k, x in enumerate(everything) if x == token]
    assert {x["token"]: x["n"] for x in S.count_tokens(files, [2, token, 40000]).collect()} == {t: everything.count(t) for t in (2, token, 40000)}


def test_shards_of_the_table(spark, tokenizer):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, S.op11_token_shards(spark, SF).collect())) == want


def search(roles, texts):
    """Cost and letters of the cheapest repair, by trying edits in order of cost and letters."""
    seen, heap = set(), [(0, "", 0, "")]
    rows = []
    for role, text in zip(roles, texts, strict=True):
        core = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
        rows.append((role[:1] or "?", core is None or (role, text) in seen, core is not None and core[0] not in ".!?"))
        seen.add((role, text))
    while heap:
        cost, letters, i, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, letters
        steps = [("I", 5, i, x) for x in "ua"]
        if i < len(rows):
            initial, bad, cut = rows[i]
            steps.append(("D", 2, i + 1, ""))
            if not bad:
                steps += [("K", 5 * cut, i + 1, initial), *(("R", 1 + 5 * cut, i + 1, x) for x in "ua")]
        for x, c, j, more in steps:
            if re.fullmatch("s?(ua)*u?", out + more):
                heapq.heappush(heap, (cost + c, letters + x, j, out + more))


def made(r, n):
    roles = [r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]) for _ in range(n)]
    return roles, [r.choice(["a.", "b!", "c", "", " \n", "d?\t", "e.", *(f"{k}." for k in range(9))]) for _ in range(n)]


def test_repair_finds_the_cheapest_and_least():
    r = random.Random(1)
    for _ in range(250):
        roles, texts = made(r, r.randint(0, 6))
        got = R.repair(list(range(len(roles))), roles, texts)
        assert (got["cost"], got["audit"]) == search(roles, texts), (roles, texts)
        left = R.repaired(got["audit"], roles, texts, 0, len(got["audit"].replace("D", "")))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left)) and got["repaired_sha256"] == hashlib.sha256("\n".join(left).encode()).hexdigest()


def test_repair_by_hand():
    got = R.repair([1, 2, 2, 5, None], ["system", "user", "user", "assistant", "user"], ["Be.", "Hi", "Hi", "Yes.", " "])
    assert {k: got[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")} == {"gaps": 2, "blank": 1, "duplicate": 1, "truncated": 1, "illegal": 1, "cost": 7, "audit": "RDDKD"}
    assert got["repaired_sha256"] == hashlib.sha256(b"user:Be.\nassistant:Yes.").hexdigest()
    none = R.repair([], [], [])
    assert none["cost"] == none["gaps"] == 0 and none["audit"] == "" and none["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert R.repair([None], ["user"], ["Hm."])["gaps"] == 0 and R.repair([1], ["user"], ["Hm."])["audit"] == "D"


def test_long_conversations_are_repaired_in_pieces(spark):
    r = random.Random(2)
    rows = []
    for c, n in ((None, 40), (1, 3), (2, 90), (3, 1), (4, 150), (5, 0), (6, 12)):
        roles, texts = made(r, n)
        rows += [(c, r.choice([None, *range(60)]), role, text, r.random() < 0.05) for role, text in zip(roles, texts, strict=True)]
    rows += [(9, 1, "user", "same.", False)] * 25 + [(8, 1, "user", "gone.", True)] * 25
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean").repartition(3)
    whole = sorted(map(tuple, R.repair_conversations(docs).collect()), key=repr)
    assert len(whole) == 8 and sorted(map(tuple, R.repair_conversations(docs, most_rows=7).collect()), key=repr) == whole
    assert sorted(map(tuple, R.repair_conversations(docs, most_bytes=20).collect()), key=repr) == whole
    for conv, turns in ((2, 90), (4, 150)):
        own = sorted(((x[1], x[2], x[3]) for x in rows if x[0] == conv and not x[4]), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert turns >= len(own) > 60
        want = R.repair(*map(list, zip(*own, strict=True)))
        assert next(x for x in whole if x[0] == conv)[1:] == tuple(want[c] for c in (*R.COUNTS, "audit", "repaired_sha256"))


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {t}?") for c in range(6) for t in range(20)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit(9)).withColumn("gone", F.lit("x"))
    got = collections.Counter(tuple(x) for x in R.damaged(docs).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        role, text = role or " ", " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[(c, t, "user" if h == 4 else role, "" if h in (0, 1) else re.sub("[.!?]", "", text) if h == 2 else text, h == 0)] += 1 + (h == 3)
    assert got == want


def test_repair_of_the_table(spark):
    rows = R.damaged(spark.read.parquet(f"{SF}/conversations.parquet")).collect()
    by = collections.defaultdict(list)
    for x in rows:
        by[x["conv_id"]] += [] if x["gone"] else [(x["turn"], x["role"], x["text"])]
    got = {x["conv_id"]: x for x in R.op12_repair(spark, SF).collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        turns, roles, texts = map(list, zip(*sorted(own), strict=True)) if own else ([], [], [])
        assert (got[conv]["cost"], got[conv]["audit"]) == search(roles, texts)


def test_audit_by_counting(spark):
    r = random.Random(4)
    words = ["The", "the", "Öl", "öl", "x1y", "a-b", "日本", "naïve", *(f"w{'abcdef'[k]}" for k in range(6))]
    rows = [(i, None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(r.randint(0, 12))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "é", None, "big", "big"])) for i in range(120)]
    rows += [(200, "only here", "xx", "s1"), (201, "", "xx", "s2"), (7, rows[7][1], rows[7][2], rows[7][3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("v", F.lit(1))
    df, tf, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        df[lang].update(set(terms))
        tf[lang, source].update(terms)
    want = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= 3]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        of = {s: shares(tf[lang, s]) for g, s in groups if g == lang}
        all_of = shares(sum((tf[lang, s] for s in of), collections.Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(sum(f(of[source][t], of[s][t]) for t in kept), s) for s in of if s != source]
        terms = [(f(of[source][t], all_of[t]), t) for t in kept if tf[lang, source][t] and of[source][t] > all_of[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, 3)):
            best = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            want |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(best, 1)}
    counts = A.term_counts(docs).cache()
    assert set(map(tuple, A.divergence(counts, ranks=3).collect())) == want and any(x[0] == "xx" and x[4] == 0 for x in want)
    assert A.divergence(A.term_counts(docs.limit(0)).cache()).count() == 0


def test_shares_are_exact_where_products_outgrow_64_bits(spark):
    rows = [(c, n) for c in (0, 1, 10**9, 9 * 10**14, 10**15) for n in (10**15 + 7, 2 * 10**15) if c < n]
    got = spark.createDataFrame(rows, "c long, n long").select("c", "n", A.share(F.col("c"), F.col("n")).alias("p")).collect()
    assert all(x["p"] == 1 + 10**9 * (x["c"] + 1) // x["n"] for x in got)
