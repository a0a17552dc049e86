"""Graph queries over entities and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import graphs as G
from cairn.sources import tables as S
from cairn.sources.staging import staged
from cairn.sources.tables import sql

Q, O = {}, {}
START, END = "ent_region_1", "ent_supplier_3"


def _edges(spark, d, direction="both"):
    return G.neighbours(S.relations(spark, d), direction)


_E = "edges as (select from_id as id, to_id as other from relations union all select to_id, from_id from relations)"


#: edges that a task tells apart at once
TASK_EDGES = 500_000


def graph_neighbors(spark, d):
    """Neighbours of each entity, and the first of them. The number of tasks follows the rows of the tables, so that each sorts some TASK_EDGES edges; an entity that many others may belong to is counted in parts."""
    rows = {t: S.table(spark, d, t).count() for t in ("nation", "customer", "supplier", "lineitem")}  # from the files' footers
    tasks = max(spark.sparkContext.defaultParallelism, -(-2 * sum(rows.values()) // TASK_EDGES))
    parts = -(-(rows["customer"] + rows["supplier"]) // TASK_EDGES)
    e = G.neighbours(S.relations(spark, d, once=False)).withColumn("part", F.pmod(F.xxhash64("other"), F.lit(max(1, parts))))
    own = e.repartition(tasks, "id", "part").distinct().groupBy("id", "part").agg(F.count("other").alias("n"), F.min("other").alias("first"))
    return own.repartition(tasks, "id").groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


O["graph_neighbors"] = sql("relations", "").rstrip() + f", {_E} select id, count(distinct other) as n, min(other) as first from edges group by id"


def graph_traverse(spark, d):
    return G.traverse(staged(spark, _edges(spark, d), "edges"), START, 3, lambda df: staged(spark, df, "front"))


O["graph_traverse"] = sql("relations", "").rstrip() + f", {_E}, h0 as (select '{START}' as id, 0 as hops)" + "".join(f", h{i} as (select * from h{i - 1} union all select distinct other, {i} from edges join h{i - 1} using (id) where hops = {i - 1} and other not in (select id from h{i - 1}))" for i in (1, 2, 3)) + " select id, hops from h3"


def graph_path(spark, d):
    return G.shortest_path(staged(spark, _edges(spark, d), "edges"), START, END, 4, lambda df: staged(spark, df, "paths")).select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


O["graph_path"] = sql("relations", "").rstrip() + f", {_E}, p0 as (select '{START}' as id, ['{START}'] as path)" + "".join(f", p{i} as (select other as id, list_append(path, other) as path from p{i - 1} join edges using (id) where not list_contains(path, other))" for i in (1, 2, 3, 4)) + f", hit as (select path from (select * from p1 union all select * from p2 union all select * from p3 union all select * from p4) where id = '{END}') select array_to_string(path, '>') as path, len(path) - 1 as hops from hit order by len(hit.path), hit.path limit 1"


def graph_relations(spark, d):
    return S.relations(spark, d).where((F.col("from_id") == "ent_nation_3") | (F.col("to_id") == "ent_nation_3")).select("from_id", "type", "to_id")


O["graph_relations"] = sql("relations", "select from_id, type, to_id from relations where from_id = 'ent_nation_3' or to_id = 'ent_nation_3'")


def _named(spark, d):
    kinds = [*G.SYNONYMS, "Depends", "owns", "custom"]
    types = ["service", "ticket", "decision", "team", "person", "api"]
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    k = F.col("key")
    return S.sources(spark, d).select("id", pick(kinds, k).alias("kind"), pick(types, k).alias("from_type"), pick(types, F.floor(k / 7)).alias("to_type"))


_KINDS = [*G.SYNONYMS, "Depends", "owns", "custom"]
_TYPES = ["service", "ticket", "decision", "team", "person", "api"]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NAMED = f"named as (select id, {_list(_KINDS)}[key % {len(_KINDS)} + 1] as kind, {_list(_TYPES)}[key % 6 + 1] as from_type, {_list(_TYPES)}[(key // 7) % 6 + 1] as to_type from sources)"
_CANON = "case lower(kind) " + " ".join(f"when '{a}' then '{b}'" for a, b in G.SYNONYMS.items()) + " else kind end"


def relation_canonical(spark, d):
    return _named(spark, d).select("id", G.canonical(F.col("kind")).alias("type"))


O["relation_canonical"] = sql("sources", "").rstrip() + f", {_NAMED} select id, {_CANON} as type from named"


def relation_validate(spark, d):
    return _named(spark, d).select("id", G.valid(F.col("kind"), F.col("from_type"), F.col("to_type")).alias("valid"))


_VALID = "case canon " + " ".join("when '{}' then {}".format(n, " and ".join(f"{side} in ({', '.join(repr(t) for t in ts)})" for side, ts in (("from_type", a), ("to_type", b)) if ts) or "true") for n, _, a, b in G.RELATIONS) + " else true end"
O["relation_validate"] = sql("sources", "").rstrip() + f", {_NAMED} select id, {_VALID} as valid from (select *, {_CANON} as canon from named)"


def graph_schema(spark, d):
    return spark.createDataFrame([(n, dr, ",".join(a), ",".join(b)) for n, dr, a, b in G.RELATIONS], "name string, directed boolean, from_types string, to_types string")


O["graph_schema"] = "select * from (values " + ", ".join(f"('{n}', {dr}, '{','.join(a)}', '{','.join(b)}')" for n, dr, a, b in G.RELATIONS) + ") as t(name, directed, from_types, to_types)"


def graph_commands(spark, d):
    """kg: and graph: commands, parsed; an error where the depth is no number."""
    k = F.col("key")
    text = F.when(k % 4 == 0, F.concat(F.lit("kg:traverse:project%3A"), k.cast("string"), F.lit(":3"))).when(k % 4 == 1, F.concat(F.lit("graph:path:a"), k.cast("string"), F.lit(":b:4"))).when(k % 4 == 2, F.concat(F.lit("kg:relations:e"), k.cast("string"))).otherwise(F.lit("kg:path:a:b"))
    p = F.split("c", ":")
    kind, n = F.element_at(p, 2), F.size(p)
    ok = ((kind == "traverse") & (n == 4)) | ((kind == "path") & (n == 5)) | ((kind == "relations") & (n == 3))
    depth = F.when(kind.isin("traverse", "path"), F.try_element_at(p, n).try_cast("int"))
    return S.sources(spark, d).select("id", text.alias("c")).select("id", kind.alias("command"), F.when(ok, F.url_decode(F.element_at(p, 3))).alias("entity"), F.when(ok, depth).alias("depth"), (~ok).alias("error"))


O["graph_commands"] = sql("sources", "select id, case key % 4 when 0 then 'traverse' when 2 then 'relations' else 'path' end as command, case key % 4 when 0 then 'project:' || key when 1 then 'a' || key when 2 then 'e' || key end as entity, case key % 4 when 0 then 3 when 1 then 4 end as depth, key % 4 = 3 as error from sources")


def kg_keys(spark, d):
    """__kg:rel:<subject>:<predicate>:<object>, percent-encoded, and back."""
    code = F.concat(F.lit("__kg:rel:"), F.url_encode("subject"), F.lit(":"), F.url_encode("predicate"), F.lit(":"), F.url_encode("object"))
    p = F.split("code", ":")
    return S.atoms(spark, d).select("id", code.alias("code")).select("id", "code", F.url_decode(p[2]).alias("subject"), F.url_decode(p[4]).alias("object"))


O["kg_keys"] = sql("atoms", "select id, '__kg:rel:' || subject || ':' || predicate || ':' || object as code, subject, object from atoms")


def entity_resolve(spark, d):
    """Entities that are one by type, name regardless of case, and scope: the least id stands for them."""
    e = S.entities(spark, d).withColumn("name", F.when(F.col("key") % 2 == 0, F.upper("name")).otherwise(F.col("name")))
    return e.groupBy("type", F.lower("name").alias("name"), "scope").agg(F.min("id").alias("id"), F.count("*").alias("n"))


O["entity_resolve"] = sql("entities", "select type, lower(name) as name, scope, min(id) as id, count(*) as n from entities group by all")

for _f in (graph_neighbors, graph_traverse, graph_path, graph_relations, relation_canonical, relation_validate, graph_schema, graph_commands, kg_keys, entity_resolve):
    Q[_f.__name__] = _f
