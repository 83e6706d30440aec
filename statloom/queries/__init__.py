"""Registered queries of the core, by family."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules with QUERIES and SQL.
FAMILIES = ("data", "ingest", "graph", "retrieval", "evaluation", "answers", "plans", "agent", "reports")


def all_queries() -> dict[str, Callable]:
    return {k: v for m in FAMILIES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in FAMILIES for k, v in import_module(f"{__name__}.{m}").SQL.items()}
