"""Permission predicates as column expressions. Malformed (null) permissions fail closed; empty ones are open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Actor:
    id: str
    scopes: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()

    @property
    def admin(self) -> bool:
        return "admin" in self.scopes

    def has(self, capability: str) -> bool:
        return self.admin or capability in self.capabilities


def _granted(scope: Column, grants: tuple[str, ...]) -> Column:
    """An exact grant, or one that ends in * and is a prefix."""
    out = scope.isin([g for g in grants if not g.endswith("*") or len(g) < 2])
    for g in grants:
        if g.endswith("*") and len(g) >= 2:
            out = out | scope.startswith(g[:-1])
    return out


def scope_visible(scope: Column, actor: Actor) -> Column:
    return F.lit(True) if actor.admin else (scope == "public") | _granted(scope, actor.scopes)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def permissions_visible(permissions: Column, actor: Actor) -> Column:
    if actor.admin:
        return F.lit(True)
    return F.coalesce((F.size(permissions) == 0) | F.arrays_overlap(permissions, _strings(("public", *actor.scopes))), F.lit(False)) & permissions.isNotNull()


def record_visible(scope: Column, permissions: Column, actor: Actor) -> Column:
    return scope_visible(scope, actor) & permissions_visible(permissions, actor)


def permissions_visible_for_actor(permissions: Column, actor: Actor) -> Column:
    return permissions_visible(permissions, actor) | F.coalesce(F.array_contains(permissions, f"actor:{actor.id}"), F.lit(False))


def scope_list_visible(required: Column, actor: Actor) -> Column:
    """All required scopes granted, public ones aside; an empty or malformed list is not visible."""
    if actor.admin:
        return F.lit(True)
    return F.coalesce((F.size(required) > 0) & F.forall(required, lambda s: scope_visible(s, actor)), F.lit(False))


def permissions_writable(permissions: Column, actor: Actor) -> Column:
    if actor.admin:
        return F.lit(True)
    return F.coalesce(F.forall(permissions, lambda p: (p == "public") | p.isin(list(actor.scopes))), F.lit(False))


def action_allowed(scope: Column, action: str, actor: Actor) -> Column:
    """write:, verify: or delete: and the scope, or such a grant with a wildcard."""
    return F.lit(True) if actor.admin else _granted(F.concat(F.lit(f"{action}:"), scope), actor.scopes)


def permissions_cover(container: Column, target: Column) -> Column:
    """An open container covers all; an open or public target needs one; else the container holds all that the target names."""
    named = (F.size(target) > 0) & ~F.array_contains(target, "public") & (F.size(F.array_except(target, container)) == 0)
    return F.coalesce(F.size(container) == 0, F.lit(False)) | F.coalesce(named, F.lit(False))


def acl_covers(container_scope: Column, container: Column, target_scope: Column, target: Column) -> Column:
    return ((container_scope == "public") | (container_scope == target_scope)) & permissions_cover(container, target)


MALFORMED = "__malformed_permissions__"


def required_access(scope: Column, permissions: Column, actor: Actor) -> Column:
    own = F.filter(F.array(scope), lambda s: ~s.isin("", "public", f"agent:{actor.id}"))
    holds = F.array_contains(permissions, f"actor:{actor.id}")
    rest = F.filter(permissions, lambda p: (p != "public") & ~(holds & p.startswith("actor:")))
    return F.array_distinct(F.concat(own, F.coalesce(rest, F.array(F.lit(MALFORMED)))))


def combine_permissions(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, F.array_distinct(b)).when(F.size(b) == 0, F.array_distinct(a)).otherwise(F.array_union(a, b))


def narrowed(requested: Column, actor: Actor) -> Column:
    """Requested scopes that the actor's grants allow; with no request, all of the actor's."""
    return F.when(F.size(requested) > 0, F.filter(requested, lambda s: scope_visible(s, actor))).otherwise(_strings(actor.scopes))


def scope_set_covers(cover: Column, required: Column) -> Column:
    return F.coalesce(~F.array_contains(required, "") & (F.size(F.array_except(F.filter(required, lambda s: s != "public"), cover)) == 0), F.lit(False))


def memory_visible(scope: Column, permissions: Column, owner: Column, session: Column, actor: Actor, session_id: str | None) -> Column:
    """A visible record, or the owner's own private scope with permissions that name them; rows of a session need that session."""
    private = (owner == actor.id) & ((scope == f"agent:{actor.id}") | (session.isNotNull() & scope.startswith("session:")))
    seen = record_visible(scope, permissions, actor) | (private & permissions_visible_for_actor(permissions, actor))
    return seen & (session.isNull() | (F.coalesce(session == session_id, F.lit(False)) if session_id is not None else F.lit(False)))


def default_status(created_by: Column, scope: Column) -> Column:
    shared = scope.startswith("project:") | scope.startswith("team:") | scope.startswith("org:")
    return F.when((created_by == "agent") & shared, "proposed").when(created_by == "human", "verified").otherwise("proposed")


def internal_key(key: Column) -> Column:
    return key.startswith("autosave_") | (key == "last_hygiene_at") | key.startswith("prompt.")


HIDDEN = ("rejected", "deprecated", "superseded")


def status_shown(status: Column) -> Column:
    return ~status.isin(*HIDDEN)
