"""Windows, keys, gates, coverage and other small rules, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import access as A
from cairn.functions import graphs as G
from cairn.functions import lexical as L
from cairn.functions import texts as X
from cairn.plans.access import _HELD, _PACKS, ME, packs
from cairn.plans.graph import _CANON
from cairn.sources import tables as S
from cairn.sources.tables import DAY, sql

Q, O = {}, {}


def search_windows(spark, d):
    """Sizes of page, candidates and rerank window of requests of many shapes, and the saturating count of what two lists hold."""
    s = S.sources(spark, d)
    limit, offset, mult, mmr, rerank = F.col("key") % 700, F.col("key") * 7 % 1300, F.col("key") % 5 + 1, F.col("key") % 2 == 0, F.col("key") % 3 == 0
    most, page = F.lit(L.WINDOW_MOST), F.least(limit, F.lit(L.PAGE_MOST))
    wide = F.least(most, page * F.when(mmr, mult).otherwise(1))
    found = F.least(most, F.greatest(F.least(most, F.least(offset, most - page) + wide), F.when(rerank, F.lit(24)).otherwise(page)))
    reranked = F.least(most, F.greatest(F.least(most, offset + page), F.lit(24)))
    none = lambda c: F.when(page == 0, 0).otherwise(c).cast("long")
    return s.select("id", page.cast("long").alias("page"), none(found).alias("candidates"), none(reranked).alias("reranked"), F.least(limit + offset, F.lit(L.LIST_MOST)).cast("long").alias("listed"))


_M = L.WINDOW_MOST
O["search_windows"] = sql("sources", f"select id, p as page, case when p = 0 then 0 else least({_M}, greatest(least({_M}, least(o, {_M} - p) + least({_M}, p * (case when key % 2 = 0 then key % 5 + 1 else 1 end))), case when key % 3 = 0 then 24 else p end)) end as candidates, case when p = 0 then 0 else least({_M}, greatest(least({_M}, o + p), 24)) end as reranked, least(l + o, {L.LIST_MOST}) as listed from (select id, key, key % 700 as l, least(key % 700, {L.PAGE_MOST}) as p, key * 7 % 1300 as o from sources)")

def term_normalisation(spark, d):
    """Words of each text as query terms: without delimiters around them, of 2 to 80 bytes, once regardless of case, the first 64."""
    ends = r"""[ \t\r\n.,;:/\\_*"'()\[\]{}<>!?-]+"""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)), lambda w: L.folded(F.regexp_replace(w, f"^{ends}|{ends}$", "")))
    kept = F.slice(F.array_distinct(F.filter(words, lambda w: F.octet_length(w).between(2, 80))), 1, 64)
    return S.sources(spark, d).select("id", F.size(kept).cast("long").alias("n"), F.array_join(kept, " ").alias("terms"))


_ENDS = r"""[ \t\r\n.,;:/\\_*"''()\[\]{}<>!?-]+"""
O["term_normalisation"] = sql("sources", f"select id, len(u) as n, array_to_string(u, ' ') as terms from (select id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:64] as u from (select id, list_filter(list_transform(regexp_extract_all(text, '[^ \\t\\r\\n]+'), lambda x: translate(regexp_replace(x, '^{_ENDS}|{_ENDS}$', '', 'g'), '{L.UPPER}', '{L.LOWER}')), lambda x: strlen(x) between 2 and 80) as w from sources))")


def relation_type_filter(spark, d, types: tuple[str, ...] = ("Belongs_To", "requires")):
    """Relations of the types asked for, told by their canonical names regardless of case; none asked for is all."""
    r = S.relations(spark, d)
    asked = [F.lower(G.canonical(F.lit(t))) for t in types]
    return (r.where(F.lower(G.canonical(F.col("type"))).isin(asked)) if types else r).groupBy("type", "from_type").agg(F.count("*").alias("n"))


O["relation_type_filter"] = sql("relations", "").rstrip() + f", asked as (select lower({_CANON}) as t from (select unnest(['Belongs_To', 'requires']) as kind)) select type, from_type, count(*) as n from (select type, from_type, {_CANON} as c from (select *, type as kind from relations)) where lower(c) in (select t from asked) group by 1, 2"


def entity_type_filter(spark, d, types: tuple[str, ...] = ("Nation", "REGION")):
    return S.entities(spark, d).where(F.lower("type").isin([t.lower() for t in types])).select("id", "type", "name")


O["entity_type_filter"] = sql("entities", "select id, type, name from entities where lower(type) in ('nation', 'region')")


def dedupe_permissions(spark, d):
    """Whether the actor may deprecate or delete a claim that a better one replaces."""
    me = A.Actor(ME.id, ME.scopes, (*ME.capabilities, "verify", "delete"))
    may = lambda action: F.lit(me.has(action)) & A.action_allowed(F.col("scope"), action, me) & A.permissions_writable(F.col("permissions"), me)
    return S.atoms(spark, d).select("id", (~F.col("status").isin("deprecated", "rejected", "superseded") & may("verify")).alias("deprecate"), may("delete").alias("delete"))


_WRITABLE = f"coalesce(len(list_filter(permissions, lambda p: p <> 'public' and not list_contains({_HELD}, p))) = 0, false)"
O["dedupe_permissions"] = sql("atoms", f"select id, status not in ('deprecated', 'rejected', 'superseded') and {_WRITABLE} as deprecate, scope = 'team:1' and {_WRITABLE} as delete from atoms")


def response_cache_key(spark, d):
    """Key of a stored answer: digest of namespace, actor, sorted scopes, canonical body and controls, each framed by its length."""
    m = S.messages(spark, d)
    body = F.regexp_replace(F.trim("content"), r"[ \t\r\n]+", " ")
    key = X.framed_sha256(F.lit("response"), F.lit(ME.id), F.lit(",".join(sorted(ME.scopes))), body, F.concat(F.lit("t="), (F.col("turn") % 3).cast("string")))
    return m.select("session_id", "turn", F.concat(F.lit("rsp_"), key).alias("cache_key"))


_SCOPES = ",".join(sorted(ME.scopes))
O["response_cache_key"] = sql("messages", f"select session_id, turn, 'rsp_' || sha256('8:response;2:a1;{len(_SCOPES)}:{_SCOPES};' || strlen(b) || ':' || b || ';' || strlen(c) || ':' || c || ';') as cache_key from (select session_id, turn, regexp_replace(trim(content, ' '), '[ \\t\\r\\n]+', ' ', 'g') as b, 't=' || (turn % 3) as c from messages)")


def content_hash(spark, d):
    """Digest of what is embedded of a source: 16 hexadecimal digits of sha256."""
    return S.sources(spark, d).select("id", F.concat(F.lit("h64_"), F.substring(F.sha2("text", 256), 1, 16)).alias("hash"))


O["content_hash"] = sql("sources", "select id, 'h64_' || substr(sha256(text), 1, 16) as hash from sources")


def transcript_path(spark, d):
    """Heading path of a transcript's lines: the session as heading, then the time and the speaker."""
    m = S.messages(spark, d).withColumn("line", F.format_string("[%02d:%02d] %s: %s", F.col("turn") % 60, F.col("conv_id") % 60, "role", "content"))
    at, who = F.regexp_extract("line", r"^\[(\d\d:\d\d)\] ", 1), F.regexp_extract("line", r"^\[\d\d:\d\d\] ([^:]+):", 1)
    return m.select("session_id", "turn", F.array_join(F.array(F.concat(F.lit("# "), "session_id"), F.concat(F.lit("timestamp:"), at), F.concat(F.lit("speaker:"), who)), " > ").alias("path"))


O["transcript_path"] = sql("messages", "select session_id, turn, concat_ws(' > ', '# ' || session_id, 'timestamp:' || regexp_extract(l, '^\\[([0-9]{2}:[0-9]{2})\\]', 1), 'speaker:' || regexp_extract(l, '^\\[[0-9:]{5}\\] ([^:]+):', 1)) as path from (select session_id, turn, format('[{:02d}:{:02d}] {}: ', turn % 60, conv_id % 60, role) || content as l from messages)")


def pack_evidence(spark, d):
    """Whether a pack names any source, artifact or claim: labelled sources, and its own where its key divides by three."""
    refs = S.lifecycle(spark, d).select(F.regexp_extract("object_id", "([0-9]+)$", 1).cast("long").alias("key"), F.lit(True).alias("ref"))
    p = packs(spark, d).join(refs.distinct(), "key", "left")
    return p.select("id", (F.coalesce("ref", F.lit(False)) | (F.col("key") % 3 == 0)).alias("evidence"))


O["pack_evidence"] = sql("sources lifecycle", "").rstrip() + _PACKS + "select id, key in (select regexp_extract(object_id, '([0-9]+)$', 1)::bigint from lifecycle) or key % 3 = 0 as evidence from packs"


def gate_permissions(spark, d):
    """Permissions that the gates of a pack stand for: without public and without the pack's own scope, each once, in order."""
    s = S.sources(spark, d).select("id", "scope", F.array(F.lit("public"), F.col("scope"), F.concat(F.lit("team:"), (F.col("key") % 4).cast("string")), F.lit("actor:a1"), F.lit("team:1")).alias("gates"))
    return s.select("id", F.array_join(F.array_distinct(F.filter("gates", lambda g: (g != "public") & (g != F.col("scope")))), ",").alias("permissions"))


O["gate_permissions"] = sql("sources", "select id, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ',') as permissions from (select id, list_filter(['public', scope, 'team:' || (key % 4), 'actor:a1', 'team:1'], lambda x: x <> 'public' and x <> scope) as g from sources)")


def session_access(spark, d):
    """Scope and permissions of stored messages: the session's own scope, all sessions where none is named, and a grant to the actor."""
    m = S.messages(spark, d).select("turn", "conv_id", F.when(F.col("conv_id") % 4 > 0, F.col("session_id")).alias("session_id"))
    return m.select("conv_id", "turn", F.coalesce(F.concat(F.lit("session:"), "session_id"), F.lit("session:*")).alias("scope"), F.to_json(F.array(F.concat(F.lit("actor:"), F.lit(ME.id)))).alias("permissions"))


O["session_access"] = sql("messages", "select conv_id, turn, case when conv_id % 4 > 0 then 'session:' || session_id else 'session:*' end as scope, '[\"actor:a1\"]' as permissions from messages")


def session_keys(spark, d):
    """Vector keys of memories: s:<length>:<session>:<key> or g:<key>, and back."""
    m = S.messages(spark, d).select("conv_id", "turn", F.when(F.col("conv_id") % 3 > 0, F.col("session_id")).alias("session_id"), F.concat(F.lit("note:"), F.col("turn").cast("string")).alias("key"))
    code = F.coalesce(F.concat(F.lit("s:"), F.octet_length("session_id").cast("string"), F.lit(":"), "session_id", F.lit(":"), "key"), F.concat(F.lit("g:"), "key"))
    m = m.select("conv_id", "turn", code.alias("code"))
    own, rest = F.col("code").startswith("s:"), F.regexp_replace("code", "^(?:s:[0-9]+|g):", "")
    n = F.when(own, F.regexp_extract("code", "^s:([0-9]+):", 1).try_cast("int"))
    return m.select("conv_id", "turn", "code", F.when(own, F.substring(rest, F.lit(1), n)).alias("session"), F.when(own, F.substring(rest, n + 2, F.length(rest))).otherwise(rest).alias("key"))


O["session_keys"] = sql("messages", "select conv_id, turn, case when s is not null then 's:' || strlen(s) || ':' || s || ':' || k else 'g:' || k end as code, s as session, k as key from (select conv_id, turn, case when conv_id % 3 > 0 then session_id end as s, 'note:' || turn as k from messages)")


def session_export_prune(spark, d, days: int = 30):
    """Exported sessions whose last message is older than the retention, counted back from the latest message."""
    g = S.messages(spark, d).groupBy("session_id").agg((F.max("created_at_ms") - F.max("conv_id") * 40_000_000).alias("last"))
    g = g.join(F.broadcast(g.agg(F.max("last").alias("now"))))  # one row
    return g.where(F.col("last") < F.col("now") - days * DAY).select("session_id", F.floor((F.col("now") - F.col("last")) / DAY).alias("age_days"))


O["session_export_prune"] = sql("messages", "").rstrip() + f", g as (select session_id, max(created_at_ms) - max(conv_id) * 40000000 as last_ from messages group by 1), n as (select max(last_) as now_ from g) select session_id, (now_ - last_) // {DAY} as age_days from g, n where last_ < now_ - 30::bigint * {DAY}"


def connector_cursor(spark, d):
    """The cursor of each connector and scope: the last that was set."""
    return S.feed(spark, d).groupBy(F.col("origin").alias("connector"), "scope").agg(F.max_by("id", F.struct("ts_ms", "id")).alias("cursor"), F.count("*").alias("updates"))


O["connector_cursor"] = sql("feed", "select origin as connector, scope, arg_max(id, (ts_ms, id)) as cursor, count(*) as updates from feed group by 1, 2")


def prompt_documents(spark, d):
    """Known documents as memory keys, with a fingerprint of all that a scope holds of them and an excerpt of the first. Digests of texts are
    added up by XOR, so no group of documents is gathered."""
    prompt = F.concat(F.lit("prompt."), F.element_at(F.array(F.lit("agents"), F.lit("style"), F.lit("tools")), (F.col("key") % 3 + 1).cast("int")))
    digest = F.sha2(F.concat(F.col("key").cast("string"), F.lit(":"), F.sha2("text", 256)), 256)
    s = S.sources(spark, d).select(prompt.alias("prompt"), "scope", "key", F.octet_length("text").alias("size"), F.substring("text", 1, 80).alias("head"), digest.alias("digest"))
    half = lambda at: F.bit_xor(F.conv(F.substring("digest", at, 8), 16, 10).cast("long"))
    g = s.groupBy("prompt", "scope").agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"), half(1).alias("a"), half(9).alias("b"), F.min_by("head", "key").alias("excerpt"))
    return g.select("prompt", "scope", "documents", "bytes", F.format_string("%08x%08x", "a", "b").alias("fingerprint"), "excerpt")


_PART = "bit_xor(('0x' || substr(sha256(key || ':' || sha256(text)), {}, 8))::bigint)"
O["prompt_documents"] = sql("sources", f"select prompt, scope, count(*) as documents, sum(strlen(text))::bigint as bytes, printf('%08x%08x', {_PART.format(1)}, {_PART.format(9)}) as fingerprint, arg_min(substr(text, 1, 80), key) as excerpt from (select *, 'prompt.' || ['agents', 'style', 'tools'][key % 3 + 1] as prompt from sources) group by 1, 2")


def analytics_literals(spark, d):
    """Texts as quoted literals and as fields of tab-separated lines: backslashes, quotes, tabs and line ends escaped."""
    s = S.sources(spark, d).select("id", F.replace("text", F.lit("\\"), F.lit("\\\\")).alias("t"))
    field = F.col("t")
    for raw, said in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        field = F.replace(field, F.lit(raw), F.lit(said))
    literal = F.concat(F.lit("'"), F.replace("t", F.lit("'"), F.lit("\\'")), F.lit("'"))
    return s.select("id", F.md5(literal).alias("literal"), F.md5(F.concat_ws("\t", "id", field)).alias("line"), F.length(field).cast("long").alias("n"))


O["analytics_literals"] = sql("sources", r"select id, md5('''' || replace(b, '''', '\''') || '''') as literal, md5(id || chr(9) || f) as line, length(f) as n from (select id, b, replace(replace(replace(b, chr(9), '\t'), chr(10), '\n'), chr(13), '\r') as f from (select id, replace(text, '\', '\\') as b from sources))")


def identity_keys(spark, d):
    """Identity of results as one text: type, store where one is named or memories are meant, and id, each framed by its length."""
    s = S.sources(spark, d).select("id", F.when(F.col("key") % 3 == 0, "agent_memory").otherwise("source").alias("type"), F.when(F.col("key") % 2 == 0, "s1").otherwise("").alias("store"))
    framed = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return s.select("id", F.concat_ws(":", framed(F.col("type")), framed(F.col("store")), F.col("id")).alias("identity"))


O["identity_keys"] = sql("sources", "select id, strlen(t) || ':' || t || ':' || strlen(st) || ':' || st || ':' || id as identity from (select id, case when key % 3 = 0 then 'agent_memory' else 'source' end as t, case when key % 2 = 0 then 's1' else '' end as st from sources)")


def propose_permission(spark, d):
    """Whether actors of three kinds may write a source or only propose it: by capability, scope and permissions."""
    out = [F.col("id")]
    for name, abilities in (("writer", ("write", "propose")), ("helper", ("propose",)), ("reader", ())):
        me = A.Actor(ME.id, ME.scopes, abilities)
        may = lambda c, me=me: F.lit(me.has(c)) & A.permissions_writable(F.col("permissions"), me)
        out.append(F.when(may("write") & A.action_allowed(F.col("scope"), "write", me), "write").when(may("propose") & A.scope_visible(F.col("scope"), me), "propose").otherwise("none").alias(name))
    return S.sources(spark, d).select(*out)


_SEE = "(scope in ('public', 'team:1', 'team:2') or starts_with(scope, 'session:'))"
O["propose_permission"] = sql("sources", f"select id, case when w and starts_with(scope, 'team:') then 'write' when w and v then 'propose' else 'none' end as writer, case when w and v then 'propose' else 'none' end as helper, 'none' as reader from (select *, {_WRITABLE} as w, {_SEE} as v from sources)")


def vector_counters(spark, d):
    """Counters of the vector outbox: pending, embedded, indexed here and elsewhere, deleted."""
    n, applied, here = F.count_if, F.col("status") == "applied", F.col("origin") == "node-0"
    return S.feed(spark, d).agg(n(F.col("status") == "pending").alias("pending"), n(applied).alias("embedded"), n(applied & here).alias("indexed_local"), n(applied & ~here).alias("indexed_external"), n(F.col("event_type").endswith(".delete")).alias("deleted"))


O["vector_counters"] = sql("feed", "select count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'applied') as embedded, count(*) filter (where status = 'applied' and origin = 'node-0') as indexed_local, count(*) filter (where status = 'applied' and origin <> 'node-0') as indexed_external, count(*) filter (where event_type like '%.delete') as deleted from feed")


def import_snapshot(spark, d):
    """Records to JSON lines and back, some in two versions, of which the last stays."""
    a = S.atoms(spark, d).select("id", "predicate", "object", "status", "created_at_ms")
    revised = a.where("created_at_ms % 7 = 0").withColumn("status", F.lit("revised")).withColumn("created_at_ms", F.col("created_at_ms") + 1)
    lines = a.unionByName(revised).select(F.to_json(F.struct(*a.columns)).alias("line"))
    back = lines.select(F.from_json("line", "id string, predicate string, object string, status string, created_at_ms long").alias("r")).select("r.*")
    return back.groupBy("id").agg(F.max_by("status", "created_at_ms").alias("status"), F.max("created_at_ms").alias("created_at_ms"), F.count("*").alias("versions"))


O["import_snapshot"] = sql("atoms", "select id, arg_max(status, created_at_ms) as status, max(created_at_ms) as created_at_ms, count(*) as versions from (select id, status, created_at_ms from atoms union all select id, 'revised', created_at_ms + 1 from atoms where created_at_ms % 7 = 0) group by id")

for _f in (search_windows, term_normalisation, relation_type_filter, entity_type_filter, dedupe_permissions, response_cache_key, content_hash, transcript_path, pack_evidence, gate_permissions, session_access, session_keys, session_export_prune, connector_cursor, prompt_documents, analytics_literals, identity_keys, propose_permission, vector_counters, import_snapshot):
    Q[_f.__name__] = _f
