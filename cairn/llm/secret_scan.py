"""Secret scan: fixed formats, and random strings exposed by how badly a byte-pair vocabulary compresses them.

Base spans are those of three formats (assign, access, hex). The method adds spans of kind `random`: runs of key-like characters that are no known digest or identifier, do not touch a base
span, and take more than one token for every `chars_per_token` characters under the vocabulary. A run is judged whole (keys hold slashes);
of one that is let off or touches a base span, each part of 16 or more characters between slashes and equals signs is judged by itself.

Excluded as known: hexadecimal of a digest's length (32, 40, 48, 56, 64, 96, 128), UUIDs, dates and version numbers, paths and addresses, and identifiers
made of words joined by separators or capitals, and codes of groups that are digits, times or up to four capitals each (orders, parts, flights, plates). Runs of small letters alone are
judged by a stricter ratio (LOWER) from LOWER_LEAST letters on, which words of the languages at hand, compounds too, stay above. The vocabulary file is a parameter; the driver reads it and broadcasts it (its size is that of the file),
and each worker builds its encoder once.

Null and empty texts have no spans. Offsets are code points, end exclusive. Rows are judged one by one, equal rows alike; other
columns are ignored; an empty table gives none. Work on a text grows with its length, however long its runs and however many its matches.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: a part of a run, with the padding at its end
SEGMENT = re.compile(r"[^/=]{16,}(?:=+(?=/|\Z))?")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: a letter that belongs to no word: a small one alone, or a capital alone that no small letter follows
LONE = re.compile(r"(?<![a-z])[a-z](?![a-z])|(?<![A-Z])[A-Z](?![A-Za-z])")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
KINDS = ("assign", "access", "hex", "random")
#: splits a run into the pieces that a byte-pair vocabulary is applied to
PIECES = r"[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9]+"
PIECE = 512
#: characters per token below which a run of small letters, of so many at least, is random: nineteen in twenty random runs are, and hardly a word
LOWER, LOWER_LEAST = 1.9, 20


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _encoding(vocabulary: str | bytes):
    """The encoder of a vocabulary file, given by its path or as what is in it."""
    import tiktoken

    raw = vocabulary_bytes(vocabulary) if isinstance(vocabulary, str) else vocabulary
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
    return tiktoken.Encoding("secrets", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _known(run: str) -> bool:
    """Digests, identifiers and numbers, which are no secrets however they are tokenised."""
    bare = run.strip("=-_/+")
    if re.fullmatch(r"[0-9a-fA-F]+", bare) and len(bare) in DIGEST_LENGTHS:
        return True
    if UUID.fullmatch(bare) or not re.search(r"[A-Za-z]", bare):
        return True
    groups = re.split(r"[-_/=+]+", bare)
    if len(groups) > 1 and all(re.fullmatch(r"[0-9]+|[A-Z]{1,4}|[0-9]{1,4}T[0-9]{2,6}Z?", g) for g in groups):
        return True
    if run.count("/") > 2 and re.search(r"/[a-z]+/", run):
        return True
    return not re.search(r"[0-9]", bare) and not LONE.search(bare) and len(re.findall(r"[A-Z]", bare)) <= len(bare) // 5


def _tokens(run: str, vocabulary: str | bytes) -> int:
    """Tokens of a run; long ones are encoded in pieces, so that the time grows with their length."""
    return sum(len(_encoding(vocabulary).encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def _random(run: str, vocabulary: str | bytes, chars_per_token: float) -> bool:
    if run.islower() and run.isalpha():
        return len(run) >= LOWER_LEAST and len(run) < min(LOWER, chars_per_token) * _tokens(run, vocabulary)
    return not _known(run) and len(run) < chars_per_token * _tokens(run, vocabulary)


def _union(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, z in sorted((a, z) for _, a, z in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return starts, ends


def random_spans(text: str, taken: list[tuple[str, int, int]], vocabulary: str | bytes, chars_per_token: float) -> list[tuple[str, int, int]]:
    out = []
    starts, ends = _union(taken)
    touched = lambda a, z: (k := bisect_left(starts, z) - 1) >= 0 and ends[k] > a
    for m in RUN.finditer(text):
        parts = [m.span()] + [(m.start() + s.start(), m.start() + s.end()) for s in SEGMENT.finditer(m[0]) if "/" in m[0] or "=" in m[0]]
        for i, (start, end) in enumerate(parts):
            if not touched(start, end) and _random(text[start:end], vocabulary, chars_per_token):
                out.append(("random", start, end))
                if i == 0:
                    break
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find(text: str, vocabulary: str | bytes = VOCABULARY, chars_per_token: float = 2.0) -> tuple[list, list]:
    """Base spans and added spans of one text."""
    base = base_spans(text)
    return base, random_spans(text, base, vocabulary, chars_per_token)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, chars_per_token: float = 2.0) -> DataFrame:
    """doc_id and array of spans (kind, start, end), by start, for each row of docs (doc_id, text)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, starts, ends, n = [], [], [], [0]
            for text in b.column("text"):
                base, more = find(text.as_py() or "", shared.value, chars_per_token)
                for k, a, z in sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
                    kinds.append(k)
                    starts.append(a)
                    ends.append(z)
                n.append(len(kinds))
            items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.array(n, np.int32)), items).cast(span)], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind: string, start: int, end: int>>")


def redact(text: str, vocabulary: str | bytes = VOCABULARY, chars_per_token: float = 2.0) -> str:
    """text with each secret replaced by its kind; of an assignment the key stays and the value goes."""
    base, more = find(text, vocabulary, chars_per_token)
    out, at = [], 0
    for k, a, z in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if k == "assign":
            a = ASSIGN.match(text, a).start(2)
        a = max(a, at)
        if a < z:
            out += [text[at:a], f"[{k.upper()}]"]
            at = z
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(said(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), said("spans").alias("spans"), n("random").alias("n_random"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the base formats alone, which SQL can say."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {"op1_secret_scan": op1_secret_scan, "secret_counts": secret_counts}
ORACLE_SQL = {
    "secret_counts": r"""
select doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) as n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex
from (select doc_id, coalesce(text, '') as t from documents)"""
}
