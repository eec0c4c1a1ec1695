"""Queries over the test tables, one module per area; every REGISTRY here is part of all_queries()."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import Query


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        registry = getattr(importlib.import_module(f"{__name__}.{m}"), "REGISTRY", None)
        if registry is not None:
            queries |= registry.queries
            sql |= registry.sql
    return queries, sql
