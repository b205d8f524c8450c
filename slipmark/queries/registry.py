"""The register of queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slipmark.queries import views

MODULES = ("prompts", "numbers", "letters", "files", "joins", "aggregates", "paging", "jobs")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(key: str, sql: str | None = None, uses: str = ""):
    """Register a query; ``uses`` names the views that its SQL needs."""

    def add(fn):
        _queries[key] = fn
        if sql is not None:
            _oracles[key] = views.with_views(sql, uses.split())
        return fn

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"slipmark.queries.{name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
