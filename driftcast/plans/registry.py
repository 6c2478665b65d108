"""The one place where queries get their names: a decorator, and the SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Inventory ids that a query covers.
COVERS: dict[str, tuple[str, ...]] = {}


def query(*ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__], COVERS[f.__name__] = f, ids
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
