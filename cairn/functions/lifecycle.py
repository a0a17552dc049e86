"""Governance rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000


def hygiene(status: Column, verified_at_ms: Column, now_ms: Column, stale_days: int = 30, archive_days: int = 90, purge_days: int = 365) -> Column:
    """What to do with a record: withdrawn ones are archived, others by the time since verification; never verified do not age."""
    age = F.coalesce(F.greatest(now_ms - verified_at_ms, F.lit(0)), F.lit(0))
    return (
        F.when(status.isin("deprecated", "rejected"), "archive").when(age > purge_days * DAY, "purge").when(age > archive_days * DAY, "archive").when(age > stale_days * DAY, "mark_stale").otherwise("keep")
    )


def fresh(created_ms: Column, ttl_ms: Column, now_ms: Column) -> Column:
    return (ttl_ms <= 0) | (now_ms <= created_ms + ttl_ms)


def status_rank(status: Column) -> Column:
    return F.when(status.isin("verified", "accepted"), 4).when(status == "proposed", 3).when(status == "stale", 2).otherwise(1)


def status_after(operation: Column) -> Column:
    return F.when(operation == "verify", "verified").when(operation == "stale", "stale").when(operation == "supersede", "superseded").when(operation.isin("delete", "forget"), "deprecated")


def operation_of(event_type: Column) -> Column:
    """Operation of a feed event by the end of its type."""
    last = F.substring_index(event_type, ".", -1)
    return F.when(last.isin("put", "created", "updated"), "put").when(last == "merge_object", "merge_object").when(last == "merge_string_set", "merge_string_set").when(last.startswith("delete"), "delete").when(last == "verified", "verify").when(last == "superseded", "supersede").otherwise("put")


# Names of storage routes and what they mean.
ROUTES = {"primary": "primary", "default": "primary", "canonical": "primary", "native": "native", "runtime": "runtime", "agent": "runtime", "all": "all", "*": "all"}
# Statuses that artifacts of each type may have.
ARTIFACT_STATUSES = {"decision": ("proposed", "accepted", "rejected", "superseded"), "runbook": ("draft", "verified", "stale", "deprecated"), "page": ("draft", "verified", "stale", "deprecated")}
