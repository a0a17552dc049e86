"""Extraction, chunking, summaries, context packs and other text queries."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import texts as X
from cairn.functions.arrays import running_sum
from cairn.sources import tables as S
from cairn.sources.staging import staged
from cairn.sources.tables import sql

Q, O = {}, {}
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
PREFIXES = [p for p, *_ in X.ATOM_RULES if p.endswith(":")] + ["Alice: we decided to", "Note:", "- Risk:", "[00:01:04] Bob: Decision:"]
_N = len(PREFIXES)


def lines(spark, d):
    """Every line of every text behind a prefix by its place, so that each rule meets real lines: id, key, n (from 0), line."""
    each = S.sources(spark, d).select("id", "key", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), ((F.col("key") + F.col("n")) % _N + 1).cast("int"))
    return each.select("id", "key", "n", F.concat(prefix, F.lit(" x"), "raw").alias("line"))


_PLACE = f"((key + n) % {_N})"
_LINES = f"raw as (select id, key, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from sources), lines as (select id, key, n, {_list(PREFIXES)}[{_PLACE} + 1] || ' x' || raw as line from raw)"
_RULES = {p: (pr, c, t) for p, pr, c, t in X.ATOM_RULES} | {"Alice: we decided to": ("decision", 0.72, "decision,inferred"), "- Risk:": ("risk", 0.72, "risk"), "[00:01:04] Bob: Decision:": ("decision", 0.86, "decision")}


def extract_atoms(spark, d):
    a = X.atoms(lines(spark, d))
    return a.select("id", "n", "atom.predicate", "atom.object", F.round("atom.confidence", 2).alias("confidence"), "atom.tags")


def _by_prefix(i: int) -> str:
    return f"case {_PLACE} " + " ".join(f"when {n} then " + (f"'{_RULES[p][i]}'" if i != 1 else f"{_RULES[p][i]}::double") for n, p in enumerate(PREFIXES) if p in _RULES) + " end"


_BODY = f"rtrim(regexp_replace(substr(line, length({_list(PREFIXES)}[{_PLACE} + 1]) + 1), '[ \\t\\r\\n*-]+$', ''))"
O["extract_atoms"] = sql("sources", "").rstrip() + f", {_LINES} select id, n, {_by_prefix(0)} as predicate, trim({_BODY}) as object, {_by_prefix(1)} as confidence, {_by_prefix(2)} as tags from lines where {_by_prefix(0)} is not null"


def _relation_lines(spark, d):
    """Lines of every form, whose ends hold the first word of the text."""
    k = F.col("key")
    phrase = F.element_at(F.array(*(F.lit(p) for p, _ in X.RELATION_PHRASES)), (k % len(X.RELATION_PHRASES) + 1).cast("int"))
    a, b = F.concat(F.lit("WORK-"), k.cast("string")), F.concat(F.lit("the service "), (k % 17).cast("string"), F.lit("s"), F.regexp_extract("text", "[A-Za-z]{2,}", 0))
    made = F.when(k % 5 == 0, F.concat(F.lit("Relation: "), a, F.lit(" -> implements -> "), b)).when(k % 5 == 1, F.concat(a, F.lit(" -> "), b)).when(k % 5 == 2, F.concat(F.lit("Link: "), a, F.lit(" "), phrase, F.lit(" "), b, F.lit("."))).when(k % 5 == 3, F.concat(F.lit("Decision: "), a, F.lit(" -> "), b)).otherwise(F.concat(a, F.lit(" "), phrase, F.lit(" "), b))
    return S.sources(spark, d).select("id", made.alias("line"))


def extract_relations(spark, d):
    r = X.relations(_relation_lines(spark, d))
    return r.select("id", "relation.from_name", "relation.type", "relation.to_name", "relation.confidence")


_PH = f"{_list([t for _, t in X.RELATION_PHRASES])}[key % {len(X.RELATION_PHRASES)} + 1]"
_TO = "'service ' || (key % 17) || 's' || regexp_extract(text, '[A-Za-z]{2,}')"
O["extract_relations"] = sql("sources", f"select id, 'WORK-' || key as from_name, case key % 5 when 0 then 'implements' when 1 then 'related_to' else {_PH} end as type, {_TO} as to_name, case key % 5 when 0 then 0.84 when 1 then 0.76 when 2 then 0.78 else 0.72 end::double as confidence from sources where key % 5 <> 3")


_NAMES = r"@[A-Za-z0-9_]+|[A-Z]+-[0-9]+|[a-z]+/[a-z]+|[A-Z]{3,}"


def extract_entities(spark, d):
    """Mentions, tickets, paths and acronyms of the whole text and a line of its own, in order of appearance, at most 64 a source."""
    text = F.concat_ws(" ", "text", F.concat(F.lit("@user"), "key"), F.concat(F.lit("TICK-"), "key"), F.lit("src/main API"))
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(_NAMES), F.lit(0)))
    return S.sources(spark, d).select("id", F.array_join(F.slice(names, 1, 64), ",").alias("names"), F.least(F.size(names), F.lit(64)).cast("long").alias("n"))


O["extract_entities"] = sql("sources", f"select id, array_to_string(u[1:64], ',') as names, least(len(u), 64) as n from (select id, list_filter(n, lambda x, i: list_position(n, x) = i) as u from (select id, regexp_extract_all(text || ' @user' || key || ' TICK-' || key || ' src/main API', '{_NAMES}') as n from sources))")


def evidence_ranges(spark, d):
    """Byte range and number of each line of each source, summed up within the row."""
    s = S.sources(spark, d).select("id", F.transform(F.split("text", "\n"), lambda x: F.octet_length(x) + 1).alias("sizes"))
    s = s.select("id", "sizes", running_sum(F.col("sizes"), F.size("sizes")).alias("upto"))
    each = s.select("id", F.posexplode(F.arrays_zip("sizes", "upto")).alias("n", "x"))
    return each.select("id", (F.col("n") + 1).alias("line"), (F.col("x.upto") - F.col("x.sizes")).cast("long").alias("start"), (F.col("x.upto") - 1).cast("long").alias("end"))


O["evidence_ranges"] = sql("sources", "select id, n::integer as line, (u - strlen(l) - 1)::bigint as start, (u - 1)::bigint as \"end\" from (select id, n, l, sum(strlen(l) + 1) over (partition by id order by n) as u from (select id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from sources))")


def grounded_evidence(spark, d):
    """Whether a quote is found in its source; every third quote is not."""
    s = S.sources(spark, d).withColumn("quote", F.concat(F.substring("text", 5, 30), F.when(F.col("key") % 3 == 0, "~").otherwise("")))
    return s.select("id", (F.col("text").contains(F.col("quote")) & (F.length("quote") > 0)).alias("grounded"))


O["grounded_evidence"] = sql("sources", "select id, contains(text, q) and length(q) > 0 as grounded from (select id, text, substr(text, 5, 30) || case when key % 3 = 0 then '~' else '' end as q from sources)")


def summary_sections(spark, d):
    """First three different lines of each section of each tenth part of the sources, how many lines it has, and what share of the part it covers."""
    tidy = lines(spark, d).withColumn("line", X.cleaned_line(F.col("line"))).withColumn("section", X.section(F.col("line"))).where("line <> ''")
    once = tidy.groupBy((F.col("key") % 10).alias("g"), "section", "line").agg(F.min(F.struct("key", "n")).alias("at"))
    top = once.withColumn("r", F.row_number().over(Window.partitionBy("g", "section").orderBy("at"))).where("r <= 3")
    text = top.groupBy("g", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    sizes = once.groupBy("g", "section").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("g").agg(F.sum("n").alias("all"))
    return text.join(sizes, ["g", "section"]).join(whole, "g").select("g", "section", "n", F.expr("(100 * n) div all").cast("long").alias("percent"), "lines")


_CLEAN = {"Alice: we decided to": "we decided to", "- Risk:": "Risk:", "[00:01:04] Bob: Decision:": "Decision:"}
_SECT = {p: next((s for s, ps in X.SECTIONS if any(_CLEAN.get(p, p).lower().startswith(q.lower()) for q in ps)), "facts") for p in PREFIXES}
_strip = f"case {_PLACE} " + " ".join(f"when {n} then substr(line, {len(p) - len(_CLEAN[p]) + 1})" for n, p in enumerate(PREFIXES) if p in _CLEAN) + f" when {PREFIXES.index('Note:')} then substr(line, 7) else line end"
O["summary_sections"] = sql("sources", "").rstrip() + f", {_LINES}, t as (select key % 10 as g, {_list([_SECT[p] for p in PREFIXES])}[{_PLACE} + 1] as section, regexp_replace({_strip}, '[ \\t\\r\\n*-]+$', '') as line, min((key, n)) as pos from lines group by 1, 2, 3), c as (select g, section, count(*) as n, sum(count(*)) over (partition by g) as a from t group by 1, 2) select g, section, c.n, ((100 * c.n) // c.a)::bigint as percent, string_agg(line, chr(10) order by pos) as lines from (select *, row_number() over (partition by g, section order by pos) as r from t) join c using (g, section) where r <= 3 group by all"


def estimate_tokens(spark, d):
    return S.sources(spark, d).select("id", X.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


O["estimate_tokens"] = sql("sources", "select id, len(regexp_extract_all(text, '[A-Za-z0-9_\\-\\x{80}-\\x{10FFFF}]+')) + len(regexp_extract_all(text, '[^A-Za-z0-9_\\-\\x{80}-\\x{10FFFF}\\s]')) as tokens from sources")


def _cost():
    return (F.octet_length("role") + F.octet_length("content") + 1).cast("long")


def message_tokens(spark, d):
    return S.messages(spark, d).select("session_id", "turn", F.expr("(octet_length(role) + octet_length(content) + 1) div 4").cast("long").alias("tokens"))


O["message_tokens"] = sql("messages", "select session_id, turn, (strlen(role) + strlen(content) + 1) // 4 as tokens from messages")


def partition_messages(spark, d, budget: int = 600):
    """Newest messages of each session that fit the budget, one at least; the others are to be summarised."""
    m = S.messages(spark, d).withColumn("cost", _cost())
    back = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    kept = m.withColumn("sum", F.sum("cost").over(back)).withColumn("n", F.row_number().over(back))
    return kept.groupBy("session_id").agg(F.count_if((F.col("sum") <= budget) | (F.col("n") == 1)).alias("keep"), F.count_if((F.col("sum") > budget) & (F.col("n") > 1)).alias("summarize"))


O["partition_messages"] = sql("messages", "select session_id, count(*) filter (s <= 600 or n = 1) as keep, count(*) filter (s > 600 and n > 1) as summarize from (select session_id, sum(strlen(role) + strlen(content) + 1) over w as s, row_number() over w as n from messages window w as (partition by session_id order by turn desc)) group by 1")


def citations_valid(spark, d):
    """Citations [message:n] of a text within 1 and the number of its lines; the text cites by its length."""
    s = S.sources(spark, d).withColumn("t", F.concat("text", F.lit(" [message:"), (F.length("text") % 6).cast("string"), F.lit("]"))).withColumn("most", F.size(F.split("text", "\n")))
    s = s.withColumn("c", F.transform(F.regexp_extract_all("t", F.lit(r"\[message:(\d+)\]"), F.lit(1)), lambda x: x.cast("long")))
    return s.select("id", (F.size("c") > 0).alias("cited"), F.forall("c", lambda x: (x >= 1) & (x <= F.col("most"))).alias("valid"))


O["citations_valid"] = sql("sources", "select id, len(c) > 0 as cited, len(list_filter(c, lambda x: x::bigint < 1 or x::bigint > most)) = 0 as valid from (select id, len(string_split(text, chr(10))) as most, regexp_extract_all(text || ' [message:' || (length(text) % 6) || ']', '\\[message:(\\d+)\\]', 1) as c from sources)")


def claims_supported(spark, d):
    """A claim holds if its message contains it, or enough of its words: all of up to four, else four or 80 percent."""
    s = S.sources(spark, d).where("length(text) > 60").withColumn("claim", F.when(F.col("key") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.concat(F.substring("text", 3, 30), F.lit(" unseenword"))))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4))
    found = F.size(F.filter("w", lambda x: F.lower("text").contains(x)))
    need = F.when(F.size("w") <= 4, F.size("w")).otherwise(F.greatest(F.lit(4), F.ceil(F.size("w") * 0.8).cast("int")))
    return s.withColumn("w", words).select("id", (F.lower("text").contains(F.lower("claim")) | ((F.size("w") >= 2) & (found >= need))).alias("supported"))


O["claims_supported"] = sql("sources", "select id, contains(lower(text), lower(claim)) or (len(w) >= 2 and len(list_filter(w, lambda x: contains(lower(text), x))) >= case when len(w) <= 4 then len(w) else greatest(4, ceil(len(w) * 0.8)) end) as supported from (select *, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z]+'), lambda x: length(x) >= 4)) as w from (select *, case when key % 3 = 0 then substr(text, 1, 40) else substr(text, 3, 30) || ' unseenword' end as claim from sources where length(text) > 60))")


def semantic_facts(spark, d):
    """Key and content of facts: the text of each source as the content of one."""
    s = S.sources(spark, d).withColumn("line", F.concat(F.lit("Key fact: topic"), F.col("key").cast("string"), F.lit(" = "), "text"))
    return s.select("id", F.regexp_extract("line", r"^Key fact: (\S+) = ", 1).alias("key"), F.md5(F.trim(F.regexp_replace("line", r"^Key fact: \S+ = ", ""))).alias("content"))


O["semantic_facts"] = sql("sources", "select id, regexp_extract(line, '^Key fact: ([^ \\t\\r\\n]+) = ', 1) as key, md5(trim(substr(line, length(regexp_extract(line, '^Key fact: ([^ \\t\\r\\n]+) = ')) + 1), ' ')) as content from (select id, 'Key fact: topic' || key || ' = ' || text as line from sources)")


def normalize_content(spark, d):
    return S.sources(spark, d).select("id", F.md5(X.normalized_content(F.col("text"))).alias("digest"))


O["normalize_content"] = sql("sources", "select id, md5(translate(regexp_replace(regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as digest from sources")


def artifact_type(spark, d):
    k = F.col("key") % 5
    kind = F.element_at(F.array(*map(F.lit, ("transcript", "chat", "ticket", "incident", "web"))), (k + 1).cast("int"))
    s = S.sources(spark, d).withColumn("kind", kind)
    return s.select("id", F.when(F.col("kind").isin("transcript", "chat"), "meeting").when(F.col("kind") == "incident", "incident").when(F.col("kind") == "ticket", "ticket").otherwise("page").alias("type"), F.substring("text", 1, 120).alias("summary"))


O["artifact_type"] = sql("sources", "select id, case when kind in ('transcript', 'chat') then 'meeting' when kind in ('incident', 'ticket') then kind else 'page' end as type, substr(text, 1, 120) as summary from (select *, ['transcript', 'chat', 'ticket', 'incident', 'web'][key % 5 + 1] as kind from sources)")


_HEADS = ("[00:01] Bob: ", "```py\n", "# Title\n", "fn main() {\n", "")
_CUTS = (("transcript", r"(?m)^\[?[0-9]{1,2}:[0-9]{2}"), ("fence", "```"), ("heading", r"(?m)^#{1,6} "), ("code", r"[{;][ \t]*(?:\n|\z)"))


def chunk_strategy(spark, d):
    """How a whole text is cut: transcript, fence, heading, code or plain, by the first that is found."""
    s = S.sources(spark, d).withColumn("t", F.concat(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("key") % 5 + 1).cast("int")), "text"))
    kind = F.lit("plain")
    for name, pattern in reversed(_CUTS):
        kind = F.when(F.col("t").rlike(pattern), name).otherwise(kind)
    return s.select("id", kind.alias("strategy"))


O["chunk_strategy"] = sql("sources", "select id, case " + " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in _CUTS) + " else 'plain' end as strategy from (select id, " + _list(_HEADS).replace("\n", "' || chr(10) || '") + "[key % 5 + 1] || text as t from sources)")


def transcript_markers(spark, d):
    m = S.messages(spark, d).withColumn("line", F.format_string("[%02d:%02d] %s: %s", F.col("turn") % 60, F.col("conv_id") % 60, "role", "content"))
    p = r"^\[(\d\d:\d\d)\] ([^:]+): "
    return m.select("session_id", "turn", F.regexp_extract("line", p, 1).alias("at"), F.regexp_extract("line", p, 2).alias("speaker"), F.octet_length(F.regexp_replace("line", p, "")).cast("long").alias("said"))


O["transcript_markers"] = sql("messages", "select session_id, turn, regexp_extract(l, '^\\[([0-9]{2}:[0-9]{2})\\] ', 1) as at, regexp_extract(l, '^\\[[0-9:]{5}\\] ([^:]+): ', 1) as speaker, strlen(regexp_replace(l, '^\\[[0-9:]{5}\\] [^:]+: ', ''))::bigint as said from (select session_id, turn, format('[{:02d}:{:02d}] {}: ', turn % 60, conv_id % 60, role) || content as l from messages)")


def projection_ids(spark, d):
    """Ids of memories and sessions from framed hashes of their parts."""
    m = S.messages(spark, d)
    return m.select("session_id", "turn", F.concat(F.lit("agm_"), X.framed_sha256(F.lit("a1"), F.col("session_id"), F.col("role"))).alias("memory_id"), F.concat(F.lit("agsm_"), F.substring(X.framed_sha256(F.col("session_id"), F.col("turn").cast("string")), 1, 24)).alias("message_id"))


O["projection_ids"] = sql("messages", "select session_id, turn, 'agm_' || sha256('2:a1;' || strlen(session_id) || ':' || session_id || ';' || strlen(role) || ':' || role || ';') as memory_id, 'agsm_' || substr(sha256(strlen(session_id) || ':' || session_id || ';' || strlen(turn::varchar) || ':' || turn || ';'), 1, 24) as message_id from messages")


def _pack_items(spark, d):
    a = S.atoms(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("memory_atom", "artifact", "relation", "agent_memory", "source", "entity"))), (F.col("key") % 6 + 1).cast("int"))
    return a.withColumn("kind", kind).withColumn("title", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("decision", "constraint", "runbook", "question", "note"))), (F.col("key") % 5 + 1).cast("int")), "id"))


_ITEMS = "items as (select *, ['memory_atom', 'artifact', 'relation', 'agent_memory', 'source', 'entity'][(key % 6 + 1)::int] as kind, concat_ws(' ', ['decision', 'constraint', 'runbook', 'question', 'note'][(key % 5 + 1)::int], id) as title from atoms)"


def _priority():
    has = lambda w: F.lower("title").contains(w)
    atom = F.when(F.col("status").isin("verified", "accepted") & has("decision"), 0).when(has("constraint"), 1).when(has("question"), 6).otherwise(2)
    artifact = F.when(has("runbook") | has("recipe"), 3).otherwise(4)
    return F.when(F.col("kind") == "memory_atom", atom).when(F.col("kind") == "artifact", artifact).when(F.col("kind") == "relation", 5).when(F.col("kind") == "agent_memory", 6).when(F.col("kind") == "source", 7).otherwise(8)


_PRI = "case when kind = 'memory_atom' then case when status in ('verified', 'accepted') and contains(title, 'decision') then 0 when contains(title, 'constraint') then 1 when contains(title, 'question') then 6 else 2 end when kind = 'artifact' then case when contains(title, 'runbook') then 3 else 4 end when kind = 'relation' then 5 when kind = 'agent_memory' then 6 when kind = 'source' then 7 else 8 end"


def context_priority(spark, d):
    p = _pack_items(spark, d).withColumn("priority", _priority())
    return p.orderBy("priority", F.desc("confidence"), "id").limit(100).select("id", "priority", F.round("confidence", 6).alias("confidence"))


O["context_priority"] = sql("atoms", "").rstrip() + f", {_ITEMS} select id, priority, round(confidence, 6) as confidence from (select *, {_PRI} as priority from items) as t order by priority, t.confidence desc, id limit 100"


def _item_cost():
    return F.lit(192) + sum((F.octet_length(c) for c in ("id", "kind", "title", "scope", "status", "text")), F.lit(0))


def context_cost(spark, d):
    return _pack_items(spark, d).select("id", _item_cost().cast("long").alias("cost"))


O["context_cost"] = sql("atoms", "").rstrip() + f", {_ITEMS} select id, 192 + strlen(id) + strlen(kind) + strlen(title) + strlen(scope) + strlen(status) + strlen(text) as cost from items"


def context_sections(spark, d):
    has = lambda w: F.lower("title").contains(w)
    atom, artifact = F.col("kind") == "memory_atom", F.col("kind") == "artifact"
    section = F.when(atom & F.col("status").isin("verified", "accepted") & has("decision"), "verified_decisions").when(atom & has("constraint"), "constraints").when(artifact & has("runbook"), "runbooks").when(atom & has("risk"), "known_risks").when(atom & has("question"), "open_questions").when(atom, "memory_atoms").when(artifact, "artifacts").when(F.col("kind") == "source", "sources").when(F.col("kind") == "entity", "entities").when(F.col("kind") == "agent_memory", "agent_memory").otherwise("relations")
    return _pack_items(spark, d).groupBy(section.alias("section")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


O["context_sections"] = sql("atoms", "").rstrip() + f", {_ITEMS} select case when kind = 'memory_atom' and status in ('verified', 'accepted') and contains(title, 'decision') then 'verified_decisions' when kind = 'memory_atom' and contains(title, 'constraint') then 'constraints' when kind = 'artifact' and contains(title, 'runbook') then 'runbooks' when kind = 'memory_atom' and contains(title, 'question') then 'open_questions' when kind = 'memory_atom' then 'memory_atoms' when kind = 'artifact' then 'artifacts' when kind = 'source' then 'sources' when kind = 'entity' then 'entities' when kind = 'agent_memory' then 'agent_memory' else 'relations' end as section, count(*) as n, min(id) as first from items group by 1"


def context_scopes(spark, d):
    """Scopes that a pack of each status needs: distinct, without public, a gate for malformed ones."""
    p = _pack_items(spark, d).select("status", F.explode(F.array_union(F.array("scope"), F.coalesce("permissions", F.array(F.lit("__malformed__"))))).alias("s")).where("s <> 'public'")
    return p.groupBy("status").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("scopes"))


O["context_scopes"] = sql("atoms", "").rstrip() + f", {_ITEMS} select status, string_agg(s, ',' order by s) as scopes from (select distinct status, unnest(list_append(coalesce(permissions, ['__malformed__']), scope)) as s from items) where s <> 'public' group by status"


LEAST_COST = 192


def context_budget(spark, d, budget: int = 4000):
    """Items of each status in order of priority while they fit; the first that does not is trimmed and ends the pack, unless it is too small to trim.

    Each pass looks at the first items of each status that can still be taken whole or trimmed, never more than fit (an item costs LEAST_COST at least),
    so a status is never gathered; packs are closed by what a pass leaves.
    """
    items = _pack_items(spark, d).select("status", "id", F.struct(_priority().alias("p"), (-F.col("confidence")).alias("c"), "id").alias("at"), _item_cost().cast("long").alias("cost"), F.octet_length("text").cast("long").alias("size"))
    items = staged(spark, items, "items")
    left = staged(spark, items.groupBy("status").agg(F.lit(budget).cast("long").alias("left"), F.lit(None).cast(items.schema["at"].dataType).alias("seen")), "left")
    most, packs = budget // LEAST_COST + 2, []

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows, left, out = rows.sort_values("r"), int(rows["left"].iloc[0]), []
        for r in rows.itertuples():
            if r.cost <= left:
                left -= r.cost
                out.append((r.status, r.id, r.cost, left, r.r))
            elif left > r.cost - r.size + 24:
                out.append((r.status, r.id, left, 0, r.r))
                left = 0
                break
            else:
                out.append((r.status, r.id, 0, left, r.r))
        return pd.DataFrame(out, columns=["status", "id", "cost", "left", "r"])

    while True:
        able = items.join(F.broadcast(left), "status").where("(seen is null or at > seen) and left > 0 and (cost <= left or left > cost - size + 24)")  # a row a status
        first = able.withColumn("r", F.row_number().over(Window.partitionBy("status").orderBy("at"))).where(F.col("r") <= most)
        taken = staged(spark, first.select("status", "id", "cost", "size", "left", "r").groupBy("status").applyInPandas(take, "status string, id string, cost long, left long, r int"), "taken")
        if taken.isEmpty():
            break
        packs.append(taken.where("cost > 0").select("status", "id", "cost"))
        last = taken.join(items.select("status", "id", "at"), ["status", "id"]).groupBy("status").agg(F.max_by("left", "r").alias("left"), F.max("at").alias("seen"))
        left = staged(spark, last, "left")
    out = packs[0] if packs else taken.select("status", "id", "cost")
    for p in packs[1:]:
        out = out.unionByName(p)
    return out


_COST = "192 + strlen(id) + strlen(kind) + strlen(title) + strlen(scope) + strlen(status) + strlen(text)"
O["context_budget"] = (
    sql("atoms", "").rstrip().replace("with ", "with recursive ", 1)
    + f", {_ITEMS}, o as (select status, id, {_COST} as cost, strlen(text) as size, row_number() over (partition by status order by {_PRI}, confidence desc, id) as r from items), f as (select status, null::varchar as id, 0::bigint as spent, 4000::bigint as left_, 0::bigint as r from o group by status union all select status, id, spent, left_, r from (select f.status, o.id, case when o.cost <= left_ then o.cost else left_ end as spent, case when o.cost <= left_ then left_ - o.cost else 0 end as left_, o.r, row_number() over (partition by f.status order by o.r) as n from f join o on f.status = o.status and o.r > f.r and left_ > 0 and (o.cost <= left_ or left_ > o.cost - o.size + 24)) where n = 1) select status, id, spent as cost from f where id is not null"
)


def segment_messages(spark, d, budget: int = 500):
    """Messages of a session packed in order into windows of at most the budget. Sessions are streamed through tasks in order, with what the
    window holds so far; none is gathered."""
    m = S.messages(spark, d).select("session_id", "turn", _cost().alias("cost"))

    def pack(batches):
        session, used, window = None, 0, 0
        for b in batches:
            out = []
            for s, c in zip(b.column("session_id").to_pylist(), b.column("cost").to_pylist(), strict=True):
                if s != session:
                    session, used, window = s, 0, 0
                if used and used + c > budget:
                    window, used = window + 1, 0
                used += c
                out.append(window)
            yield pa.RecordBatch.from_arrays([b.column("session_id"), b.column("turn"), pa.array(out, pa.int32())], names=["session_id", "turn", "window"])

    return m.repartition("session_id").sortWithinPartitions("session_id", "turn").mapInArrow(pack, "session_id string, turn long, window int")


O["segment_messages"] = sql("messages", "").rstrip().replace("with ", "with recursive ", 1) + ", o as (select session_id, turn, strlen(role) + strlen(content) + 1 as c, row_number() over (partition by session_id order by turn) as r from messages), p as (select session_id, turn, c as used, 0 as w, r from o where r = 1 union all select o.session_id, o.turn, case when used + c > 500 then c else used + c end, case when used + c > 500 then w + 1 else w end, o.r from p join o on o.session_id = p.session_id and o.r = p.r + 1) select session_id, turn, w as \"window\" from p"


def qmd_normalize(spark, d):
    """Search hits with snippets of at most 60 characters and 600 in all for each type, in order."""
    s = S.sources(spark, d).where("length(text) > 0").select("id", "type", "key", F.least(F.length("text"), F.lit(60)).alias("take"))
    w = Window.partitionBy("type").orderBy("key")
    s = s.withColumn("n", F.row_number().over(w)).withColumn("sum", F.sum("take").over(w)).where("n <= 20 and sum - take < 600")
    return s.select("id", F.least(F.col("take"), 600 - (F.col("sum") - F.col("take"))).cast("long").alias("chars"))


O["qmd_normalize"] = sql("sources", "select id, least(t, 600 - (s - t))::bigint as chars from (select id, t, row_number() over w as n, sum(t) over w as s from (select id, type, key, least(length(text), 60) as t from sources where length(text) > 0) window w as (partition by type order by key)) where n <= 20 and s - t < 600")


def primitive_mirror(spark, d):
    a = S.atoms(spark, d)
    m = a.select("id", F.lit("primitive:memory_atom").alias("category"), F.concat(F.lit("primitive:memory_atom:"), "id").alias("key"), F.concat_ws("\n", "predicate", "text").alias("content"))
    return m.withColumn("back", F.element_at(F.split("key", ":"), 3))


O["primitive_mirror"] = sql("atoms", "select id, 'primitive:memory_atom' as category, 'primitive:memory_atom:' || id as key, predicate || chr(10) || text as content, id as back from atoms")


def write_effects(spark, d):
    """What each write causes: a feed event, a projection, and a mirror job for what is shown."""
    a = S.atoms(spark, d)
    feed, projection = a.select("id", F.lit("feed").alias("effect")), a.where("status <> 'rejected'").select("id", F.lit("projection").alias("effect"))
    return feed.unionByName(projection).unionByName(a.where("status = 'verified'").select("id", F.lit("mirror").alias("effect")))


O["write_effects"] = sql("atoms", "").rstrip() + ", a as (select * from atoms) select id, 'feed' as effect from a union all select id, 'projection' from a where status <> 'rejected' union all select id, 'mirror' from a where status = 'verified'"


def chunk_documents(spark, d):
    return X.chunks(S.sources(spark, d).select("id", F.concat(F.lit("# "), "type", F.lit("\n"), "text").alias("text")))


def redact_text(spark, d):
    return X.redacted(S.sources(spark, d)).select("id", F.length("text").cast("long").alias("n"), F.regexp_count("text", F.lit(r"\[[A-Z]+_\d+\]")).cast("long").alias("masks"))


def pii_counts(spark, d):
    # an address begins where a run of its characters does, or where the match before ended: no place of a run is tried twice
    p = {"emails": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "phones": r"\+[0-9][0-9 ().-]{6,}[0-9]", "tokens": r"(?:sk-|ghp_|xoxb-|pat_)[A-Za-z0-9_-]+"}
    return S.sources(spark, d).select("id", *(F.regexp_count("text", F.lit(v)).cast("long").alias(k) for k, v in p.items()))


O["pii_counts"] = sql("sources", "select id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) as emails, len(regexp_extract_all(text, '\\+[0-9][0-9 ().-]{6,}[0-9]')) as phones, len(regexp_extract_all(text, '(?:sk-|ghp_|xoxb-|pat_)[A-Za-z0-9_-]+')) as tokens from sources")


def session_markdown(spark, d):
    m = S.messages(spark, d).where("role <> '__runtime_command__'").select("session_id", F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "content").alias("t")).alias("x"))
    return m.groupBy("session_id").agg(F.concat(F.concat(F.lit("# "), F.col("session_id")), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n")).alias("markdown"))


O["session_markdown"] = sql("messages", "select session_id, '# ' || session_id || chr(10) || string_agg('## ' || role || chr(10) || content, chr(10) order by turn) as markdown from messages where role <> '__runtime_command__' group by 1")


def markdown_import(spark, d):
    """Front matter, title and status of Markdown pages made of the sources, and the digest of the whole page."""
    s = S.sources(spark, d).withColumn("md", F.concat(F.when(F.col("key") % 2 == 0, F.concat(F.lit("---\ntype: "), F.when(F.col("key") % 3 == 0, "runbook").otherwise("decision"), F.lit("\n---\n"))).otherwise(""), F.lit("# "), "id", F.lit("\n"), "text"))
    kind = F.coalesce(F.nullif(F.regexp_extract("md", r"(?s)^---\n.*?type: (\w+).*?\n---", 1), F.lit("")), F.lit("page"))
    return s.select("id", F.regexp_extract("md", r"(?m)^# (.+)$", 1).alias("title"), kind.alias("type"), F.when(kind == "decision", "proposed").otherwise("draft").alias("status"), F.md5("md").alias("digest"))


O["markdown_import"] = sql("sources", "select id, title, type, case when type = 'decision' then 'proposed' else 'draft' end as status, digest from (select id, regexp_extract(md, '(?m)^# (.+)$', 1) as title, coalesce(nullif(regexp_extract(md, '(?s)^---\\n.*?type: ([A-Za-z0-9_]+).*?\\n---', 1), ''), 'page') as type, md5(md) as digest from (select id, case when key % 2 = 0 then '---' || chr(10) || 'type: ' || (case when key % 3 = 0 then 'runbook' else 'decision' end) || chr(10) || '---' || chr(10) else '' end || '# ' || id || chr(10) || text as md from sources))")


def multilingual_tokens(spark, d):
    """Bigrams of Chinese runs, runs of other scripts, words elsewhere."""
    t = F.concat_ws(" ", "text", F.lit("知識管理 검색은 поиск"))
    han = F.regexp_extract_all("t", F.lit("[\\u4E00-\\u9FFF]+"), F.lit(0))
    pairs = F.flatten(F.transform(han, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    hangul = F.transform(F.regexp_extract_all("t", F.lit("[\\uAC00-\\uD7AF]+"), F.lit(0)), lambda w: F.regexp_replace(w, "(?:은|는|이|가|을|를)$", ""))
    words = F.regexp_extract_all(F.lower("t"), F.lit("[a-zà-ÿ0-9а-я]+"), F.lit(0))
    found = F.array_distinct(F.concat(words, pairs, hangul))
    return S.sources(spark, d).withColumn("t", t).select("id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("tokens"))


O["multilingual_tokens"] = sql("sources", "select id, len(u) as n, md5(array_to_string(u, ' ')) as tokens from (select id, list_filter(a, lambda x, i: list_position(a, x) = i) as u from (select id, regexp_extract_all(lower(t), '[a-zà-ÿ0-9а-я]+') || flatten(list_transform(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]+'), lambda r: list_transform(generate_series(1, greatest(length(r) - 1, 1)), lambda i: substr(r, i, 2)))) || list_transform(regexp_extract_all(t, '[\\x{AC00}-\\x{D7AF}]+'), lambda w: regexp_replace(w, '(?:은|는|이|가|을|를)$', '')) as a from (select id, text || ' 知識管理 검색은 поиск' as t from sources)))")

for _f in (extract_atoms, extract_relations, extract_entities, evidence_ranges, grounded_evidence, summary_sections, estimate_tokens, message_tokens, partition_messages, citations_valid, claims_supported, semantic_facts, normalize_content, artifact_type, chunk_strategy, transcript_markers, projection_ids, context_priority, context_cost, context_sections, context_scopes, context_budget, segment_messages, qmd_normalize, primitive_mirror, write_effects, chunk_documents, redact_text, pii_counts, session_markdown, markdown_import, multilingual_tokens):
    Q[_f.__name__] = _f
