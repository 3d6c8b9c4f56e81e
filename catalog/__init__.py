"""Registered queries: each runs an operator over the given tables and, where SQL can say it, carries its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the views of ``catalog.views`` by name."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            from catalog.views import with_views

            ORACLES[name] = with_views(sql)
        return fn

    return register


def load_all() -> None:
    from catalog import attempts, datasets, evaluation, functions, graphs, routing, stats, tables  # noqa: F401
