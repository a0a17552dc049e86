"""Permission queries and permission-filtered listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import access as A
from cairn.sources import tables as S
from cairn.sources.tables import sql

ME = A.Actor("a1", ("public", "team:1", "team:2", "session:*", "write:team:*", "delete:team:1", "verify:*"), ("propose",))
_VIS = "(scope = 'public' or scope in ('public', 'team:1', 'team:2', 'write:team:*', 'delete:team:1', 'verify:*') or starts_with(scope, 'session:') or starts_with(scope, 'write:team:') or starts_with(scope, 'verify:'))"
_HELD = "['public', 'team:1', 'team:2', 'session:*', 'write:team:*', 'delete:team:1', 'verify:*']"
_PERM = f"(permissions is not null and (len(permissions) = 0 or list_has_any(permissions, {_HELD})))"
_SEEN = f"({_VIS} and {_PERM})"
Q, O = {}, {}


def _sources(f):
    return lambda spark, d: f(S.sources(spark, d))


def _bool(name, column, text):
    Q[name] = _sources(lambda s: s.select("id", "scope", column().alias("ok")))
    O[name] = sql("sources", f"select id, scope, {text} as ok from sources")



def _register() -> None:
    _bool("acl_scope_visible", lambda: A.scope_visible(F.col("scope"), ME), _VIS)
    _bool("acl_permissions_visible", lambda: A.permissions_visible(F.col("permissions"), ME), _PERM)
    _bool("acl_record_visible", lambda: A.record_visible(F.col("scope"), F.col("permissions"), ME), _SEEN)
    needed = lambda: F.array(F.col("scope"), F.concat(F.lit("team:"), (F.col("key") % 4).cast("string")))
    _bool("acl_scope_list", lambda: A.scope_list_visible(F.when(F.col("key") % 6 == 0, F.array().cast("array<string>")).otherwise(needed()), ME), f"key % 6 <> 0 and {_VIS} and ('team:' || (key % 4)) in ('team:1', 'team:2')")
    _bool("acl_writable", lambda: A.permissions_writable(F.col("permissions"), ME), f"coalesce(len(list_filter(permissions, lambda p: p <> 'public' and not list_contains({_HELD}, p))) = 0, false)")
    Q["acl_actions"] = _sources(lambda s: s.select("id", *(A.action_allowed(F.col("scope"), a, ME).alias(f"can_{a}") for a in ("write", "verify", "delete")), F.lit(ME.has("propose")).alias("can_propose")))
    O["acl_actions"] = sql("sources", "select id, starts_with(scope, 'team:') as can_write, true as can_verify, scope = 'team:1' as can_delete, true as can_propose from sources")
    _bool("acl_actor_grant", lambda: A.permissions_visible_for_actor(F.col("permissions"), ME), f"{_PERM} or coalesce(list_contains(permissions, 'actor:a1'), false)")
    box_scope = lambda: F.when(F.col("key") % 2 == 0, "public").otherwise(F.col("scope"))
    box = lambda: F.when(F.col("key") % 3 == 0, F.array()).otherwise(F.array(F.lit("team:0"), F.lit("team:9"), F.lit("actor:a1"))).cast("array<string>")
    _bool("acl_covers", lambda: A.acl_covers(box_scope(), box(), F.col("scope"), F.col("permissions")), "(key % 2 = 0 or true) and (key % 3 = 0 or coalesce(len(permissions) > 0 and not list_contains(permissions, 'public') and len(list_filter(permissions, lambda p: p not in ('team:0', 'team:9', 'actor:a1'))) = 0, false))")
    Q["required_access"] = _sources(lambda s: s.select("id", F.array_join(A.required_access(F.col("scope"), F.col("permissions"), ME), ",").alias("required")))
    own = "case when scope in ('', 'public', 'agent:a1') then null else scope end"
    rest = f"case when permissions is null then '{A.MALFORMED}' else array_to_string(list_filter(permissions, lambda p: p <> 'public' and p <> scope and not (list_contains(permissions, 'actor:a1') and starts_with(p, 'actor:'))), ',') end"
    O["required_access"] = sql("sources", f"select id, concat_ws(',', {own}, nullif({rest}, '')) as required from sources")
    other = lambda: F.when(F.col("key") % 2 == 0, F.array(F.lit("team:2"), F.lit("team:9"))).otherwise(F.array()).cast("array<string>")
    Q["combine_permissions"] = _sources(lambda s: s.where(F.col("permissions").isNotNull()).select("id", F.array_join(A.combine_permissions(F.col("permissions"), other()), ",").alias("both")))
    O["combine_permissions"] = sql("sources", "select id, array_to_string(permissions || list_filter(b, lambda x: not list_contains(permissions, x)), ',') as \"both\" from (select *, case when key % 2 = 0 then ['team:2', 'team:9'] else [] end as b from sources where permissions is not null)")
    asked = lambda: F.when(F.col("key") % 3 == 0, F.array()).otherwise(F.array(F.col("scope"), F.lit("team:2"), F.lit("secret"))).cast("array<string>")
    Q["scope_narrowing"] = _sources(lambda s: s.select("id", F.array_join(A.narrowed(asked(), ME), ",").alias("scopes")))
    O["scope_narrowing"] = sql("sources", f"select id, case when key % 3 = 0 then array_to_string({_HELD}, ',') else concat_ws(',', case when {_VIS} then scope end, 'team:2') end as scopes from sources")
    owner = lambda: F.when(F.col("key") % 2 == 0, "a1").otherwise("a2")
    session = lambda: F.when(F.col("scope").startswith("session:"), F.substring_index(F.col("scope"), ":", -1))
    _bool("agent_memory_visible", lambda: A.memory_visible(F.col("scope"), F.col("permissions"), owner(), session(), ME, "sess_1"), f"({_SEEN} or (key % 2 = 0 and starts_with(scope, 'session:') and ({_PERM} or coalesce(list_contains(permissions, 'actor:a1'), false)))) and (not starts_with(scope, 'session:') or scope = 'session:sess_1')")
    _bool("session_gate", lambda: session().isNull() | (session() == "sess_2"), "not starts_with(scope, 'session:') or scope = 'session:sess_2'")
    by = lambda: F.when(F.col("key") % 3 == 0, "human").otherwise("agent")
    Q["default_status"] = _sources(lambda s: s.select("id", A.default_status(by(), F.col("scope")).alias("status")))
    O["default_status"] = sql("sources", "select id, case when by_ = 'agent' and regexp_matches(scope, '^(project|team|org):') then 'proposed' when by_ = 'human' then 'verified' else 'proposed' end as status from (select *, case when key % 3 = 0 then 'human' else 'agent' end as by_ from sources)")
    key = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("autosave_", "pref.", "last_hygiene_at", "note_"))), (F.col("key") % 4 + 1).cast("int")), F.when(F.col("key") % 4 == 2, "").otherwise(F.col("key").cast("string")))
    content = lambda: F.when(F.col("key") % 5 == 0, F.concat(F.lit("**autosave_"), F.col("key").cast("string"), F.lit("**: kept"))).otherwise(F.lit("plain"))
    Q["internal_keys"] = _sources(lambda s: s.select("id", (A.internal_key(key()) | A.internal_key(F.regexp_extract(F.trim(content()), r"^\*\*(.+?)\*\*:", 1))).alias("internal")))
    O["internal_keys"] = sql("sources", "select id, regexp_matches(k, '^(autosave_|last_hygiene_at$)') or regexp_matches(c, '^\\*\\*(autosave_|last_hygiene_at\\*)') as internal from (select id, ['autosave_', 'pref.', 'last_hygiene_at', 'note_'][key % 4 + 1] || case when key % 4 = 2 then '' else key::varchar end as k, case when key % 5 = 0 then '**autosave_' || key || '**: kept' else 'plain' end as c from sources)")
    Q["scope_set_covers"] = _sources(lambda s: s.select("id", A.scope_set_covers(F.array(F.lit("team:1"), F.lit("team:2"), F.lit("session:sess_0")), F.array(F.col("scope"), F.lit("public"))).alias("covered")))
    O["scope_set_covers"] = sql("sources", "select id, scope in ('public', 'team:1', 'team:2', 'session:sess_0') as covered from sources")


_register()


def list_sources(spark, d):
    """Visible sources with their status, newest first."""
    s, life = S.sources(spark, d), S.lifecycle(spark, d)
    seen = s.where(A.record_visible(F.col("scope"), F.col("permissions"), ME)).join(life, s["id"] == life["object_id"], "left").withColumn("status", F.coalesce("status", F.lit("active")))
    return seen.where(A.status_shown(F.col("status"))).select("id", "type", "scope", "status", "created_at_ms").orderBy(F.desc("created_at_ms"), "id").limit(5000)


def lifecycle_overlay(spark, d):
    s, life = S.sources(spark, d), S.lifecycle(spark, d)
    return s.join(life, s["id"] == life["object_id"], "left").groupBy(F.coalesce("status", F.lit("active")).alias("status")).agg(F.count("*").alias("n"))


def list_artifacts(spark, d):
    """Orders' claims stand for artifacts with a status of their own."""
    return S.atoms(spark, d).where(A.record_visible(F.col("scope"), F.col("permissions"), ME) & A.status_shown(F.col("status"))).select("id", "status", "scope", F.round("confidence", 6).alias("confidence")).orderBy(F.desc("confidence"), "id").limit(500)


def list_entities(spark, d):
    return S.entities(spark, d).where(A.record_visible(F.col("scope"), F.col("permissions"), ME)).select("id", "type", "name", "scope")


def list_relations(spark, d):
    """Edges whose two ends are visible."""
    r, e = S.relations(spark, d), list_entities(spark, d).select("id")
    return r.join(e.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(e.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "type", "to_id")


def packs(spark, d):
    return S.sources(spark, d).select(F.concat(F.lit("ctx_"), F.col("key").cast("string")).alias("id"), F.col("key"), F.array(F.col("scope"), F.concat(F.lit("team:"), (F.col("key") % 3).cast("string"))).alias("required_scopes"), (F.col("key") % 10 == 0).alias("isolated"), "created_at_ms")


_PACKS = ", packs as (select 'ctx_' || key as id, key, [scope, 'team:' || (key % 3)] as required_scopes, key % 10 = 0 as isolated, scope, created_at_ms from sources) "


def list_context_packs(spark, d):
    return packs(spark, d).where(A.scope_list_visible(F.col("required_scopes"), ME)).select("id", F.array_join("required_scopes", ",").alias("required"))


def pack_scope(spark, d):
    """Scope that a stored pack is fed under: the actor's own, or the first that is not public."""
    first = F.element_at(F.filter("required_scopes", lambda s: s != "public"), 1)
    return packs(spark, d).select("id", F.when(F.col("isolated"), F.lit("agent:a1")).otherwise(F.coalesce(first, F.lit("public"))).alias("scope"))


def pack_ref_check(spark, d):
    """Whether no reference of a pack asks more than the pack does."""
    refs = packs(spark, d).select("id", "required_scopes", F.explode(F.array(F.array(F.element_at("required_scopes", 1)), F.array(F.lit("public"), F.when(F.col("key") % 3 == 0, "team:7").otherwise("public")))).alias("ref"))
    return refs.groupBy("id").agg(F.min(A.scope_set_covers(F.col("required_scopes"), F.col("ref"))).alias("valid"))


def visible_owners(spark, d):
    """Memory rows whose owner is the actor or a shared owner of a granted scope."""
    s = S.sources(spark, d).withColumn("owner", F.when(F.col("key") % 3 == 0, "a1").when(F.col("key") % 3 == 1, F.concat(F.lit("shared:"), F.col("scope"))).otherwise("a2"))
    owners = ["a1", "shared:public", *(f"shared:{x}" for x in ME.scopes)]
    return s.where(F.col("owner").isin(owners)).select("id", "owner")


def redacted_entries(spark, d):
    """First visible sources as bullets of one context block a scope."""
    s = S.sources(spark, d).where(A.record_visible(F.col("scope"), F.col("permissions"), ME) & (F.length(F.trim("text")) > 0))
    from pyspark.sql import Window

    top = s.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("created_at_ms"), "id"))).where("n <= 5")
    line = F.concat(F.lit("- "), F.col("id"), F.lit(": "), F.regexp_replace(F.substring("text", 1, 80), r"[\r\n]+", " "))
    return top.select("scope", F.struct("n", line.alias("line")).alias("x")).groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("block"))


Q |= {"list_sources": list_sources, "lifecycle_overlay": lifecycle_overlay, "list_artifacts": list_artifacts, "list_entities": list_entities, "list_relations": list_relations, "list_context_packs": list_context_packs, "pack_scope": pack_scope, "pack_ref_check": pack_ref_check, "visible_owners": visible_owners, "prefetch_context": redacted_entries}
O |= {
    "list_sources": sql("sources lifecycle", f"select id, type, scope, coalesce(status, 'active') as status, created_at_ms from sources left join lifecycle on id = object_id where {_SEEN} and coalesce(status, 'active') not in ('rejected', 'deprecated', 'superseded') order by created_at_ms desc, id limit 5000"),
    "lifecycle_overlay": sql("sources lifecycle", "select coalesce(status, 'active') as status, count(*) as n from sources left join lifecycle on id = object_id group by 1"),
    "list_artifacts": sql("atoms", f"select id, status, scope, round(confidence, 6) as confidence from atoms where {_SEEN} and status not in ('rejected', 'deprecated', 'superseded') order by round(confidence, 6) desc, id limit 500"),
    "list_entities": sql("entities", f"select id, type, name, scope from entities where {_SEEN}"),
    "list_relations": sql("entities relations", f"select from_id, r.type, to_id from relations r where from_id in (select id from entities where {_SEEN}) and to_id in (select id from entities where {_SEEN})"),
    "list_context_packs": sql("sources", "").rstrip() + _PACKS + f"select id, array_to_string(required_scopes, ',') as required from packs where {_VIS} and key % 3 in (1, 2)",
    "pack_scope": sql("sources", "").rstrip() + _PACKS + "select id, case when isolated then 'agent:a1' when scope <> 'public' then scope else 'team:' || (key % 3) end as scope from packs",
    "pack_ref_check": sql("sources", "").rstrip() + _PACKS + "select id, list_has_all(list_append(required_scopes, 'public'), [required_scopes[1]]) and list_has_all(list_append(required_scopes, 'public'), ['public', case when key % 3 = 0 then 'team:7' else 'public' end]) as valid from packs",
    "visible_owners": sql("sources", f"select id, owner from (select id, scope, case when key % 3 = 0 then 'a1' when key % 3 = 1 then 'shared:' || scope else 'a2' end as owner from sources) where owner in ('a1', 'shared:public') or substr(owner, 8) in (select unnest({_HELD}))"),
    "prefetch_context": sql("sources", f"select scope, string_agg('- ' || id || ': ' || regexp_replace(substr(text, 1, 80), '[\\r\\n]+', ' ', 'g'), chr(10) order by n) as block from (select *, row_number() over (partition by scope order by created_at_ms desc, id) as n from sources where {_SEEN} and length(trim(text)) > 0) where n <= 5 group by scope"),
}
