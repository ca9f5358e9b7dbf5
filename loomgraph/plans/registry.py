"""The registered queries, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.tables import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("graph_queries", "resolve_queries", "news_queries", "claim_queries", "text_queries", "merge_queries", "stream_queries")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"loomgraph.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
