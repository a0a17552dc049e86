"""What language models answer, read by column expressions: rankings in free text, identifiers in whole texts, structured summaries as JSON."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cairn.functions import lexical as L
from cairn.functions import texts as X
from cairn.plans.text import _CLEAN, _N, _PLACE, _SECT, PREFIXES, _list, _strip
from cairn.sources import tables as S
from cairn.sources.tables import sql

Q, O = {}, {}
#: what parts tokens of a reply, and fields of it whose values are no candidates
TOKEN = r"[^ \t\r\n,;:\[\]{}()\"'`*#]+"
ASIDE = r"\"?(?:score|relevance|confidence|reason|total)\"?[ ]*[:=][ ]*(?:\"[^\"]*\"|-?[0-9.]+)"


def ranking(reply: Column, ids: Column) -> Column:
    """1-based places in `ids` in the order that a reply names them, by number or by id; unknown and repeated ones ignored, those left out appended.
    Lists, prose and JSON (whole or cut off) are read alike, token by token."""
    tokens = F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(reply, F.lit("")), ASIDE, " "), F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, r"[.!?]+$", ""))
    number = lambda t: F.when(t.rlike("^[0-9]{1,9}$"), t.cast("int"))
    place = lambda t: F.when(number(t).between(1, F.size(ids)), number(t)).otherwise(F.nullif(F.array_position(ids, t), F.lit(0).cast("long")).cast("int"))
    named = F.array_distinct(F.filter(F.transform(tokens, place), lambda p: p.isNotNull()))
    every = F.when(F.size(ids) > 0, F.sequence(F.lit(1), F.size(ids))).otherwise(F.array().cast("array<int>"))
    return F.concat(named, F.array_except(every, named))


def _asked(spark, d):
    """Groups of some twenty sources as candidates, and a reply to each: words of the first text, then numbers and ids in the ways that models write them; some cut off."""
    s = S.sources(spark, d).select((F.col("key") / 20).cast("long").alias("g"), "key", "id", "text")
    g = s.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "id", F.substring("text", 1, 80).alias("text")))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("c"))
    g = g.select("g", F.col("c.id").alias("ids"), F.get("c", F.lit(0))["text"].alias("head"))
    said = lambda j: (F.col("g") * 7 + j * 5) % 24
    known = lambda j: F.concat(F.lit("src_"), (F.col("g") * 20 + said(j)).cast("string"))
    ways = [F.concat(F.lit("1. ["), said(1).cast("string"), F.lit("], then "), known(2), F.lit(" and "), said(3).cast("string"), F.lit(")")), F.concat(F.lit('{"ranking":["'), known(1), F.lit('",'), said(2).cast("string"), F.lit(',"'), known(3), F.lit('"],"score":5}')), F.concat(F.lit('[{"id":"'), known(4), F.lit('","score":0.'), said(1).cast("string"), F.lit('},{"id":"'), known(2), F.lit('","sco')), F.lit("")]
    way = F.element_at(F.array(*ways), (F.col("g") % 4 + 1).cast("int"))
    return g.select("g", "ids", F.concat("head", F.lit("\n"), way).alias("reply"))


def reply_ranking(spark, d):
    """The order that each reply gives its candidates."""
    a = _asked(spark, d).withColumn("p", ranking(F.col("reply"), F.col("ids")))
    return a.select("g", F.array_join(F.transform("p", lambda i: F.get("ids", i - 1)), ",").alias("ids"), F.size("p").cast("long").alias("n"))


_SAID = "((g * 7 + {j} * 5) % 24)"
_KNOWN = "'src_' || (g * 20 + " + _SAID + ")"
_said, _known = (lambda j: _SAID.format(j=j)), (lambda j: _KNOWN.format(j=j))
O["reply_ranking"] = sql("sources", "").rstrip() + f""", c as (select key // 20 as g, list(id order by key) as ids, first(substr(text, 1, 80) order by key) as head from sources group by 1),
a as (select g, ids, head || chr(10) || case g % 4 when 0 then '1. [' || {_said(1)} || '], then ' || {_known(2)} || ' and ' || {_said(3)} || ')' when 1 then '{{"ranking":["' || {_known(1)} || '",' || {_said(2)} || ',"' || {_known(3)} || '"],"score":5}}' when 2 then '[{{"id":"' || {_known(4)} || '","score":0.' || {_said(1)} || '}},{{"id":"' || {_known(2)} || '","sco' else '' end as reply from c),
t as (select g, ids, list_transform(regexp_extract_all(regexp_replace(reply, '"?(?:score|relevance|confidence|reason|total)"?[ ]*[:=][ ]*(?:"[^"]*"|-?[0-9.]+)', ' ', 'g'), '[^ \\t\\r\\n,;:\\[\\]{{}}()"''`*#]+'), lambda x: regexp_replace(x, '[.!?]+$', '')) as w from a),
p as (select g, ids, list_filter(list_transform(w, lambda x: case when regexp_full_match(x, '[0-9]{{1,9}}') and x::int between 1 and len(ids) then x::int else list_position(ids, x) end), lambda x: x > 0) as p from t),
o as (select g, ids, list_filter(p, lambda x, i: list_position(p, x) = i) as u from p),
f as (select g, ids, u || list_filter(generate_series(1, len(ids)), lambda x: not list_contains(u, x)) as u from o)
select g, array_to_string(list_transform(u, lambda x: ids[x]), ',') as ids, len(u) as n from f"""


def _identified(spark, d):
    """Whole texts with a line of identifiers of every kind behind them."""
    k, kind = F.col("key"), F.col("type")
    line = F.concat_ws(" ", F.concat(F.lit("WORK-"), k), F.concat(F.lit("MemoryStore"), k % 7), F.concat(kind, F.lit(":searchIndex"), k % 5), F.concat(F.lit("lib/"), kind, F.lit("/mainPart")), F.when(k % 3 == 0, "HTTPServer2").otherwise("API"))
    return S.sources(spark, d).select("id", F.concat("text", F.lit("\n"), line).alias("q"))


def identifier_expansion(spark, d):
    """Intents and terms of the identifiers in every whole text: tickets, camel case and acronyms, scope:value, paths."""
    intents, terms = L.identifier_terms(F.col("q"))
    return _identified(spark, d).select("id", F.array_join(intents, ",").alias("intents"), F.array_join(terms, ",").alias("terms"))


def _parts_sql(t: str) -> str:
    out = t
    for a, b in (("[a-z]", "[A-Z]"), ("[A-Za-z]", "[0-9]"), ("[0-9]", "[A-Za-z]"), ("[A-Z]", "[A-Z][a-z]")):
        out = f"regexp_replace({out}, '({a})({b})', '\\1' || chr(31) || '\\2', 'g')"
    return f"string_split({out}, chr(31))"


_CAMEL = "regexp_full_match(t, '[A-Za-z0-9]{3,}') and (regexp_matches(t, '[A-Z].*[A-Z]') and regexp_matches(t, '[a-z0-9]') or regexp_full_match(t, '[A-Z]{3,12}'))"
_SCOPED, _TICKET = "regexp_matches(t, '^[^:]+:.')", "regexp_full_match(t, '[A-Za-z]+-[0-9]+')"
_none = "[]::varchar[]"
_TERM_ENDS = r"""[ \t\r\n.,;:/\\_*"''()\[\]{}<>!?-]+"""
O["identifier_expansion"] = sql("sources", "").rstrip() + f""", q as (select id, text || chr(10) || concat_ws(' ', 'WORK-' || key, 'MemoryStore' || (key % 7), type || ':searchIndex' || (key % 5), 'lib/' || type || '/mainPart', case when key % 3 = 0 then 'HTTPServer2' else 'API' end) as q from sources),
t as (select id, list_filter(regexp_extract_all(q, '[^ \\t\\r\\n.,;()\\[\\]{{}}<>!?"'']+'), lambda t: strlen(t) >= 2) as w from q),
e as (select id, list_transform(w, lambda t: {{'i': (case when {_TICKET} then ['ticket'] else {_none} end) || (case when {_CAMEL} then ['entity_lookup'] else {_none} end) || (case when {_SCOPED} then ['scoped_lookup'] else {_none} end) || (case when contains(t, '/') then ['repository'] else {_none} end),
  'x': (case when {_TICKET} then [t, 'ticket', 'issue', 'task'] else {_none} end) || (case when {_CAMEL} then {_parts_sql('t')} else {_none} end) || (case when {_SCOPED} then [split_part(t, ':', 1)] || {_parts_sql("substr(t, length(split_part(t, ':', 1)) + 2)")} else {_none} end) || (case when contains(t, '/') then ['repo', 'repository'] || flatten(list_transform(string_split(t, '/'), lambda y: {_parts_sql('y')})) else {_none} end)}}) as e from t),
f as (select id, flatten(list_transform(e, lambda s: s.i)) as i, list_filter(list_transform(flatten(list_transform(e, lambda s: s.x)), lambda y: translate(regexp_replace(y, '^{_TERM_ENDS}|{_TERM_ENDS}$', '', 'g'), '{L.UPPER}', '{L.LOWER}')), lambda y: strlen(y) between 2 and 80) as x from e)
select id, array_to_string(list_filter(i, lambda y, n: list_position(i, y) = n), ',') as intents, array_to_string(list_filter(x, lambda y, n: list_position(x, y) = n)[1:64], ',') as terms from f"""

CAP = 3
_NAMES = [*(n for n, _ in X.SECTIONS), "facts"]


def _items(spark, d):
    """Items of every session: (session_id, at, n, section, text, role) of each line that is not empty; lines stand behind a prefix by their place, as in `lines`."""
    m = S.messages(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1)
    each = m.select("session_id", "at", "role", F.posexplode(F.split("content", "\n")).alias("n", "raw"))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), ((F.col("at") + F.col("n")) % _N + 1).cast("int"))
    line = X.cleaned_line(F.concat(prefix, F.lit(" x"), "raw"))
    return each.select("session_id", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), X.section(line).alias("section"), line.alias("text"), "role").where("text <> ''")


def _capped(spark, d):
    rank = F.row_number().over(Window.partitionBy("session_id", "section").orderBy("at", "n"))
    return _items(spark, d).withColumn("r", rank).where(F.col("r") <= CAP)


def session_summary(spark, d):
    """Each session as typed sections with their first items, as JSON, with its quality: items cite the message they come from, and coverage counts citations that exist."""
    held = F.array_sort(F.collect_list(F.struct("at", "n", "section", "text", "role")))
    g = _capped(spark, d).groupBy("session_id").agg(held.alias("x"))
    of = lambda k: F.filter("x", lambda i: i["section"] == F.lit(k))
    sections = F.struct(*(F.transform(of(k), lambda i: F.struct(i["text"].alias("text"), i["at"].alias("message_index"), i["role"].alias("role"))).alias(k) for k in _NAMES))
    counts = _items(spark, d).groupBy("session_id").agg(F.count("*").alias("all"))
    messages = S.messages(spark, d).groupBy("session_id").agg(F.count("*").alias("messages"))
    quality = F.struct(F.lit("extractive_structured").alias("strategy"), F.col("messages").alias("message_count"), F.size("x").alias("item_count"), F.expr("(100 * size(filter(x, i -> i.at < messages))) div size(x)").alias("citation_coverage"), (F.col("all") > F.size("x")).alias("truncated"))
    return messages.join(g, "session_id").join(counts, "session_id").select("session_id", F.to_json(sections).alias("sections"), F.to_json(quality).alias("quality"))


_ITEMS = f"""m0 as (select *, row_number() over (partition by session_id order by turn) - 1 as mi from messages),
r0 as (select session_id, mi as key, role, unnest(string_split(content, chr(10))) as raw, generate_subscripts(string_split(content, chr(10)), 1) - 1 as n from m0),
l0 as (select session_id, key, role, n, {_list(PREFIXES)}[{_PLACE} + 1] || ' x' || raw as line from r0),
it as (select session_id, key as mi, n, {_list([_SECT[p] for p in PREFIXES])}[{_PLACE} + 1] as section, regexp_replace({_strip}, '[ \\t\\r\\n*-]+$', '') as text, role from l0),
cp as (select * from it qualify row_number() over (partition by session_id, section order by mi, n) <= {CAP})"""
_section = lambda k: f"'{k}': coalesce(list({{'text': text, 'message_index': mi, 'role': role}} order by mi, n) filter (where section = '{k}'), [])"
O["session_summary"] = sql("messages", "").rstrip() + f", {_ITEMS} select c.session_id, to_json({{{', '.join(map(_section, _NAMES))}}})::varchar as sections, to_json({{'strategy': 'extractive_structured', 'message_count': first(messages), 'item_count': count(*), 'citation_coverage': (100 * count(*) filter (where mi < messages)) // count(*), 'truncated': first(\"all\") > count(*)}})::varchar as quality from cp c join (select session_id, count(*) as messages from messages group by 1) using (session_id) join (select session_id, count(*) as \"all\" from it group by 1) using (session_id) group by 1"


def summary_text(spark, d):
    """The lines of each session's summary as a model might give them back: each cites the message after its own, so the last ones cite none that exists."""
    line = F.concat(F.lit("- "), "text", F.lit(" [message:"), (F.col("at") + 2).cast("string"), F.lit("]"))
    return _capped(spark, d).select("session_id", line.alias("line"))


def citation_coverage(spark, d):
    """Share of a summary's lines whose first citation names a message of the session, as a whole percentage, and whether all do."""
    messages = S.messages(spark, d).groupBy("session_id").agg(F.count("*").alias("messages"))
    cited = F.regexp_extract("line", r"\[message:([0-9]{1,9})\]", 1)
    good = (cited != "") & F.coalesce(cited.cast("long").between(1, F.col("messages")), F.lit(False))
    g = summary_text(spark, d).join(messages, "session_id").groupBy("session_id").agg(F.count("*").alias("items"), F.count_if(good).alias("cited"))
    return g.select("session_id", "items", F.expr("(100 * cited) div items").cast("long").alias("coverage"), (F.col("cited") == F.col("items")).alias("enough"))


O["citation_coverage"] = sql("messages", "").rstrip() + f", {_ITEMS}, c as (select session_id, regexp_extract('- ' || text || ' [message:' || (mi + 2) || ']', '\\[message:([0-9]{{1,9}})\\]', 1) as said from cp), g as (select session_id, count(*) as items, count(*) filter (where try_cast(said as bigint) between 1 and messages) as n from c join (select session_id, count(*) as messages from messages group by 1) using (session_id) group by 1) select session_id, items, (100 * n) // items as coverage, n = items as enough from g"

MOST = (1 << 63) - 1


def retrieved_items(spark, d):
    """Items that a session's retrieval counts, each message with a factor; the count stops at the greatest number instead of turning over."""
    m = S.messages(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.min("conv_id").alias("c"))
    return m.select("session_id", L.saturated_product(F.col("n"), F.expr("shiftleft(1L, cast(c % 63 as int))")).alias("items"))


O["retrieved_items"] = sql("messages", f"select session_id, least(count(*)::hugeint * (1::hugeint << (min(conv_id) % 63)::int), {MOST}::hugeint)::bigint as items from messages group by 1")

for _f in (retrieved_items, reply_ranking, identifier_expansion, session_summary, citation_coverage):
    Q[_f.__name__] = _f
