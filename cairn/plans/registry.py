"""Every query of the engine itself, by name, with its SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("access", "search", "vectors", "graph", "text", "feed", "rules", "streams", "batch", "replies", "stores")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"cairn.plans.{m}").Q
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"cairn.plans.{m}").O
    return out
