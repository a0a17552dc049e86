"""Queries and oracles of this subpackage, by name."""

from __future__ import annotations

import importlib

MODULES = ("secret_scan", "html_extract", "language_id", "decontaminate", "mixing", "pii", "quality_rules", "near_dup", "lm_score", "quality_model", "token_shards", "repair", "source_audit")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"cairn.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"cairn.llm.{name}"), "ORACLE_SQL", {})
    return out
