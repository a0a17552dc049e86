"""Lines to claims and relations, token estimates, transcript marks, chunks and redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line prefix, predicate, confidence, tags, in the order in which they are tried.
ATOM_RULES = (
    ("Decision:", "decision", 0.86, "decision"), ("ADR:", "decision", 0.84, "decision,adr"), ("Decided:", "decision", 0.82, "decision"), ("we decided to ", "decision", 0.72, "decision,inferred"),
    ("Constraint:", "constraint", 0.82, "constraint"), ("Requirement:", "requirement", 0.76, "requirement"), ("Action:", "action_item", 0.74, "action_item"), ("Action item:", "action_item", 0.76, "action_item"),
    ("TODO:", "action_item", 0.68, "action_item,todo"), ("Question:", "open_question", 0.68, "open_question"), ("Open question:", "open_question", 0.72, "open_question"), ("Risk:", "risk", 0.72, "risk"),
    ("Owner:", "owner", 0.70, "owner"), ("Assignee:", "owner", 0.72, "owner,ticket"), ("Status:", "status", 0.66, "status"), ("Priority:", "priority", 0.64, "priority,ticket"),
    ("Acceptance criteria:", "requirement", 0.74, "requirement,acceptance_criteria"), ("Depends on:", "depends_on", 0.72, "dependency"), ("Blocked by:", "blocked_by", 0.72, "dependency,blocked"),
    ("Affects:", "affects", 0.70, "relation,impact"), ("Impact:", "impact", 0.70, "incident,impact"), ("Symptom:", "symptom", 0.68, "incident,symptom"), ("Root cause:", "root_cause", 0.76, "incident,root_cause"),
    ("Mitigation:", "mitigation", 0.74, "incident,mitigation"), ("Fix:", "mitigation", 0.72, "fix,mitigation"), ("Follow-up:", "follow_up", 0.70, "follow_up"), ("PR:", "related_pr", 0.72, "pr,code"),
    ("Commit:", "related_commit", 0.68, "commit,code"), ("Supersedes:", "supersedes", 0.80, "supersedes"),
)
# Phrases between the ends of a relation and its type, in order.
RELATION_PHRASES = (
    ("produced decision", "produced"), ("is superseded by", "superseded_by"), ("is blocked by", "blocked_by"), ("depends upon", "depends_on"), ("depends on", "depends_on"), ("blocked by", "blocked_by"), ("implements", "implements"),
    ("supersedes", "supersedes"), ("affected", "affected"), ("affects", "affects"), ("fixes", "fixes"), ("produced", "produced"), ("documents", "documents"), ("belongs to", "belongs_to"), ("creates", "creates"), ("created", "created"), ("owns", "owns"), ("uses", "uses"),
)
# Sections of a summary and the prefixes of their lines, in the order in which they are tried.
SECTIONS = (
    ("topics", ("Topic:", "Topics:", "Agenda:")), ("decisions", ("Decision:", "Decided:", "ADR:")), ("constraints", ("Constraint:", "Constraints:", "Invariant:")), ("owners", ("Assigned:", "Assignee:", "Responsible:", "Owner:")),
    ("action_items", ("Action:", "Action item:", "TODO:", "Next step:")), ("risks", ("Risk:", "Risks:", "Concern:", "Issue:")), ("open_questions", ("Question:", "Open question:", "Q:")), ("timeline", ("Timeline:", "At:", "Event:")),
    ("root_causes", ("Root cause:", "Cause:")), ("mitigations", ("Mitigation:", "Mitigated:", "Fix:")), ("follow_ups", ("Follow-up:", "Follow up:", "Followup:", "Lesson:", "Lesson learned:")),
)


def starts(text: Column, prefix: str) -> Column:
    return F.lower(F.substring(text, 1, len(prefix))) == prefix.lower()


def cleaned_line(line: Column) -> Column:
    """Without bullets, a leading bracket, and a speaker's name unless it is a prefix that has a meaning."""
    t = F.regexp_replace(line, r"^[ \t\r\n*-]+|[ \t\r\n*-]+$", "")
    t = F.regexp_replace(t, r"^\[[^\]]*\][ \t\r\n-]*", "")
    reserved = "|".join(re.escape(p.rstrip(":")) for p, *_ in ATOM_RULES if p.endswith(":"))
    return F.regexp_replace(t, rf"^(?i)(?!{reserved})(?=[^:]{{0,79}}[a-z])[a-z][a-z0-9 ._-]{{0,79}}:[ \t\r\n-]*", "")


_PREFIX = "^(" + "|".join(re.escape(p.lower()) for p, *_ in ATOM_RULES if p.endswith(":")) + ")"
_LONGEST = max(len(p) for p, *_ in ATOM_RULES)
_INSIDE = [(n, p) for n, (p, *_) in enumerate(ATOM_RULES) if not p.endswith(":")]


def atom_key(line: Column) -> Column:
    """The first rule that holds of a line, by its prefix or phrase in lower case; null if none does. Only the head of the line is folded; prefixes are one expression (none begins another)."""
    head = F.regexp_extract(F.lower(F.substring(line, 1, _LONGEST)), _PREFIX, 1)
    key = F.when(head != "", head)
    for n, phrase in reversed(_INSIDE):
        before = [p.lower() for p, *_ in ATOM_RULES[:n] if p.endswith(":")]
        key = F.when(~head.isin(before) & line.rlike("(?i)" + phrase), phrase).otherwise(key)
    return key


def atom_of(line: Column, key: Column) -> Column:
    """Struct of predicate, object, confidence and tags of a line under its rule; the object may be empty."""
    rules = F.create_map(*(x for p, k, c, t in ATOM_RULES for x in (F.lit(p.lower()), F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), F.lit(t).alias("t")))))
    start = F.when(key.endswith(":"), F.length(key)).otherwise(F.instr(F.lower(line), key) + F.length(key) - 1) + 1
    return F.struct(rules[key]["k"].alias("predicate"), F.trim(F.substring(line, start, F.lit(1 << 30))).alias("object"), rules[key]["c"].alias("confidence"), rules[key]["t"].alias("tags"))


def atom(line: Column) -> Column:
    """The claim of one line, null if it makes none."""
    made = atom_of(line, atom_key(line))
    return F.when(atom_key(line).isNotNull() & (F.length(made["object"]) > 0), made)


def atoms(df: DataFrame, line: str = "line") -> DataFrame:
    """The lines of df that make a claim, cleaned, with `atom`. Each step is exploded, so that what stands on it does not compute it again."""
    clean = df.withColumn(line, F.explode(F.array(cleaned_line(F.col(line)))))
    keyed = clean.withColumn("__key", F.explode(F.array_compact(F.array(atom_key(F.col(line))))))
    return keyed.withColumn("atom", atom_of(F.col(line), F.col("__key"))).where(F.length("atom.object") > 0).drop("__key")


_TRIM = " \t\r\n\"'`.,;:()[]{}<>"


def endpoint(text: Column) -> Column:
    """An end of a relation without quotes, punctuation, `the` and the kind of thing it is; null if it cannot be a name."""
    trim = "[" + re.escape(_TRIM) + "]+"
    t = F.regexp_replace(text, f"^{trim}|{trim}$", "")
    t = F.trim(F.regexp_replace(t, "^(?i)the ", ""))
    t = F.regexp_replace(F.regexp_replace(t, "^(?i)(?:ticket|issue|decision|adr|pr|pull request|incident) (?=.)", ""), f"^{trim}|{trim}$", "")
    return F.when(t.rlike(r"^[A-Za-z0-9 _\-/:#.@]{2,160}$") & t.rlike("[A-Za-z0-9]"), t)


def relations(df: DataFrame, line: str = "line") -> DataFrame:
    """The lines of df that state a relation, with `relation`: ends, type and confidence of `a -> type -> b`, `a -> b` or one of the
    phrases. Lines that make a claim of another kind are no relations unless they say so."""
    none = F.lit(None).cast("struct<from_name: string, type: string, to_name: string>")
    ends = lambda a, t, b: F.struct(endpoint(a).alias("from_name"), t.alias("type"), endpoint(b).alias("to_name"))
    claim = "^(?i)(?:" + "|".join(re.escape(p) for p, *_ in ATOM_RULES if p.endswith(":")) + ")"
    t, body, p = F.col("__t"), F.col("__body"), F.col("__p")
    out = df.withColumn("__t", F.regexp_replace(line, r"[.!;, ]+$", "")).withColumn("__said", F.when(starts(t, "Relation:"), 1).when(starts(t, "Link:"), 2).when(t.rlike(claim), -1).otherwise(0))
    out = out.withColumn("__body", F.when(F.col("__said") > 0, F.trim(F.regexp_replace(t, "^[A-Za-z]+:", ""))).otherwise(t)).withColumn("__p", F.split("__body", "->", 3))
    arrow = F.when(F.size(p) == 3, ends(p[0], F.regexp_replace(p[1], r"^\s+|\s+$", ""), p[2])).when(F.size(p) == 2, ends(p[0], F.lit("related_to"), p[1])).otherwise(none)
    phrases = F.array(*(F.struct(F.lit(f" {w} ").alias("w"), F.lit(k).alias("k")) for w, k in RELATION_PHRASES))
    split = lambda x: F.split(body, F.concat(F.lit("(?i)"), x["w"]), 2)
    met = F.transform(F.filter(phrases, lambda x: F.lower(body).contains(x["w"])), lambda x: ends(split(x)[0], x["k"], split(x)[1]))
    whole = lambda x: x["from_name"].isNotNull() & x["to_name"].isNotNull() & (F.length(x["type"]) > 0)
    out = out.withColumn("__arrow", arrow).withColumn("__met", F.try_element_at(F.filter(met, whole), F.lit(1)))
    scale = F.create_map(F.lit(1), F.lit(0.80), F.lit(2), F.lit(0.78), F.lit(0), F.lit(0.72))
    with_confidence = lambda x, more: F.struct(x["from_name"].alias("from_name"), x["type"].alias("type"), x["to_name"].alias("to_name"), F.round(scale[F.col("__said")] + more, 2).alias("confidence"))
    found = F.when(F.col("__said") < 0, None).when(whole(F.col("__arrow")), with_confidence(F.col("__arrow"), 0.04)).when(F.col("__met").isNotNull(), with_confidence(F.col("__met"), 0.0))
    return out.withColumn("relation", F.explode(F.filter(F.array(found), lambda x: x.isNotNull()))).drop("__t", "__said", "__body", "__p", "__arrow", "__met")


def section(line: Column) -> Column:
    out = F.lit("facts")
    for name, prefixes in reversed(SECTIONS):
        for p in prefixes:
            out = F.when(starts(line, p), name).otherwise(out)
    return out


def estimated_tokens(text: Column) -> Column:
    """Runs of letters, digits, non-ASCII, _ and - count one; other bytes that are not white space one each."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9_\\-\\u0080-\\x{10FFFF}]+")) + F.regexp_count(text, F.lit("[^A-Za-z0-9_\\-\\u0080-\\x{10FFFF}\\s]"))


def normalized_content(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"[ \t\r\n]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def framed_sha256(*parts: Column) -> Column:
    """sha256 over `length:part;` of each part, so that parts cannot run into each other."""
    framed = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(";"))]
    return F.sha2(F.concat(*framed), 256)


HEADING = re.compile(r"^(#{1,6})\s+(.*)$", re.M)


MARK = re.compile(rb"^\[(\d{1,2}:\d{2}(?::\d{2})?)\][ \t]*(?:([A-Za-z][^:\n]{0,79}):)?", re.M)


def chunk_text(text: str, size: int = 1800, overlap: int = 180) -> list[tuple[int, int, str]]:
    """(start, end, heading path) of chunks of at most `size` bytes, cut at the best place within the window. The path ends with the time and the speaker
    of the first transcript line of the chunk, where it has one. One walk over the headings: work grows with the text, however many it has."""
    raw, out, at = text.encode(), [], 0
    marks = [(m.start(), len(m[1]), m[2].strip()) for m in re.finditer(rb"^(#{1,6})[ \t]+(.*)$", raw, re.M)]
    places = [m for m, _, _ in marks]
    passed, path = 0, {}
    while at < len(raw):
        while passed < len(marks) and places[passed] <= at:
            _, level, title = marks[passed]
            path = {k: v for k, v in path.items() if k < level} | {level: title.decode("utf-8", "replace")}
            passed += 1
        end = min(len(raw), at + size)
        headed = False
        if passed < len(marks) and places[passed] < end:  # a heading ends a chunk in the last window too
            end, headed = places[passed], True
        elif end < len(raw):
            window = raw[at:end]
            for sep in (b"\n```", b"\n\n", b"\n", b". ", b" "):
                k = window.rfind(sep)
                if k > size // 4:
                    end = at + k + len(sep)
                    break
            headed = passed < len(marks) and places[passed] == end
            while end < len(raw) and (raw[end] & 0xC0) == 0x80:
                end -= 1
        said = MARK.search(raw, at, end)
        names = [f"{kind}:{x.decode('utf-8', 'replace')}" for kind, x in zip(("timestamp", "speaker"), said.groups(), strict=True) if x] if said else []
        out.append((at, end, " > ".join([*(path[k] for k in sorted(path)), *names])))
        if end >= len(raw):
            break
        nxt = max(end if headed else end - overlap, at + 1)
        while nxt < len(raw) and (raw[nxt] & 0xC0) == 0x80:
            nxt += 1
        at = nxt
    return out


def chunks(docs: DataFrame, size: int = 1800, overlap: int = 180) -> DataFrame:
    """(id, ordinal, start_byte, end_byte, heading_path) of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *c) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) for n, c in enumerate(chunk_text(t or "", size, overlap))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "ordinal", "start_byte", "end_byte", "heading_path"])

    return docs.select("id", "text").mapInArrow(run, "id string, ordinal int, start_byte long, end_byte long, heading_path string")


# What redaction replaces, in the order in which it is tried at each place.
REDACTIONS = (
    ("SECRET", r"(?i)\b(?:api_key|apikey|password|secret|token|access_key|private_key|client_secret)\s*[=:]\s*[^\s,;]+"),
    ("TOKEN", r"(?i)\bbearer [A-Za-z0-9._~+/=-]+|\b(?:sk-|ghp_|github_pat_|xoxb-|xoxp-|pat_)[A-Za-z0-9_-]+"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b"),
    ("PHONE", r"\+[0-9][0-9 ().-]{6,}[0-9]"),
    ("ID", r"(?i)\b(?:id|user_id|customer_id|passport|ssn)=[A-Za-z0-9-]+"),
)
_KINDS = [k for k, _ in REDACTIONS]
_OTHERS = re.compile("|".join(f"(?P<{k}>{p.removeprefix('(?i)')})" for k, p in REDACTIONS if k != "EMAIL"), re.I)
_LOCAL, _DOMAIN, _EDGE = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"), re.compile(r"\b")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _sensitive(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost matches of REDACTIONS, the earlier rule first where two begin at one place. Addresses are found by their runs, each looked at once, so work grows with the text."""
    found = ((m.start(), m.end(), d.end()) for m in _LOCAL.finditer(text) if m.end() < len(text) and text[m.end()] == "@" and (d := _DOMAIN.match(text, m.end())))
    at, other, address = 0, _OTHERS.search(text), next(found, None)
    while True:
        if other and other.start() < at:
            other = _OTHERS.search(text, at)
        start = None
        while address and start is None:  # the run's first word edge from here on
            edge = _EDGE.search(text, max(address[0], at))
            if address[1] > at and edge and edge.start() < address[1]:
                start = edge.start()
            else:
                address = next(found, None)
        if start is None and not other:
            return
        if start is not None and (not other or (start, _KINDS.index("EMAIL")) < (other.start(), _KINDS.index(other.lastgroup or ""))):
            yield start, address[2], "EMAIL"
            at = address[2]
        else:
            yield other.start(), other.end(), other.lastgroup or ""
            at = max(other.end(), at)


def redactable(text: str) -> Iterator[tuple[int, int, str]]:
    """Matches that are replaced: all but cards without separators or whose checksum fails."""
    for start, end, kind in _sensitive(text):
        digits = re.sub(r"\D", "", text[start:end]) if kind == "CARD" else ""
        if kind != "CARD" or len(digits) < end - start and _luhn(digits):
            yield start, end, kind


def redact(text: str) -> str:
    """Each match as [KIND_n], n by first appearance of the value."""
    seen: dict[tuple[str, str], int] = {}
    counts: dict[str, int] = {}
    out, at = [], 0
    for start, end, kind in redactable(text):
        value = text[start:end]
        if (kind, value) not in seen:
            counts[kind] = seen[kind, value] = counts.get(kind, 0) + 1
        out += [text[at:start], f"[{kind}_{seen[kind, value]}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([redact(t or "") for t in b.column("text").to_pylist()], pa.string())], names=["id", "text"])

    return docs.select("id", "text").mapInArrow(run, "id string, text string")
