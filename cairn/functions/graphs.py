"""Relation schema, graph commands, and breadth-first search by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relation types, whether they have a direction, and the types they may join (none: any).
RELATIONS = (
    ("related_to", False, (), ()),
    ("depends_on", True, (), ()),
    ("implements", True, ("ticket", "feature", "pr", "commit", "repo", "service", "agent", "task"), ("decision", "spec", "feature", "api", "service", "concept")),
    ("produced", True, ("meeting", "incident", "event", "agent", "task"), ("decision", "ticket", "artifact", "memory_atom", "concept")),
    ("supersedes", True, ("decision", "artifact", "memory_atom", "relation", "entity", "spec", "runbook"), ("decision", "artifact", "memory_atom", "relation", "entity", "spec", "runbook")),
    ("documents", True, ("document", "page", "artifact", "runbook", "recipe", "spec", "repo", "project", "service"), ("service", "project", "api", "feature", "concept", "team")),
    ("affected", True, ("decision", "incident", "event", "change", "release"), ("service", "api", "project", "feature", "customer", "repo")),
    ("fixes", True, ("pr", "commit", "ticket", "change"), ("ticket", "incident", "bug", "issue", "service")),
    ("belongs_to", True, ("runbook", "recipe", "service", "repo", "api", "feature", "ticket"), ("service", "project", "team", "organization")),
    ("owns", True, ("person", "team", "agent"), ("project", "service", "ticket", "decision", "feature", "runbook", "repo", "api")),
    ("used_context_pack", True, ("agent", "task", "ticket", "workflow"), ("context_pack",)),
)
SYNONYMS = {
    "related": "related_to", "relates_to": "related_to", "touches": "related_to", "depends": "depends_on", "requires": "depends_on", "uses": "depends_on",
    "created": "produced", "creates": "produced", "generated": "produced", "replaces": "supersedes", "supersede": "supersedes", "doc": "documents", "describes": "documents",
    "affects": "affected", "impacts": "affected", "impacted": "affected", "fixed": "fixes", "part_of": "belongs_to",
}


def canonical(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(kind)), kind)


def valid(kind: Column, from_type: Column, to_type: Column) -> Column:
    """Whether the ends of a relation are of types that its schema allows; relations it does not know are allowed."""
    out = F.lit(True)
    for name, _, starts, ends in RELATIONS:
        ok = F.lit(True)
        for side, types in ((from_type, starts), (to_type, ends)):
            ok = ok & F.lower(side).isin(*types) if types else ok
        out = F.when(F.lower(canonical(kind)) == name, ok).otherwise(out)
    return out


def neighbours(relations: DataFrame, direction: str = "both") -> DataFrame:
    """(id, other) of each edge, seen from the ends that the direction allows."""
    out = relations.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"))
    back = relations.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"))
    return {"outbound": out, "inbound": back}.get(direction, out.unionByName(back))


def traverse(edges: DataFrame, start: str, depth: int, cut_lineage=lambda df: df) -> DataFrame:
    """(id, hops) of what is reached from start in at most `depth` hops, each at its least."""
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    front = seen
    for hop in range(1, depth + 1):
        front = front.join(edges, "id").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        front = cut_lineage(front)
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, most: int, cut_lineage=lambda df: df) -> DataFrame:
    """The first path in order of length, then of ids: (path array), or no row."""
    paths = edges.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = paths.select("id")
    for _ in range(most):
        if not paths.where(F.col("id") == end).isEmpty():
            break
        step = paths.join(edges, "id").select(F.col("other").alias("id"), F.concat("path", F.array("other")).alias("path")).join(seen, "id", "left_anti")
        paths = cut_lineage(step.groupBy("id").agg(F.min("path").alias("path")))
        seen = seen.unionByName(paths.select("id"))
    return paths.where(F.col("id") == end).select("path")
