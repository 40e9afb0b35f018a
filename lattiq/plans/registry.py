"""All queries by name, each beside its DuckDB twin.

Query modules register with ``@query(sql)``; the function's name is the query's name and it
takes (spark, sf_dir). Queries that SQL cannot express register without a twin.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("prepare", "describe", "order", "maps", "outliers", "search", "verify", "sequences", "runs", "engine", "reports", "models", "studies", "images", "streams")


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        if fn.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {fn.__name__}")
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lattiq.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
