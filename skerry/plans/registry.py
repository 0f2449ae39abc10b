"""Where queries and their DuckDB twins are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may use the role views of views.py by name."""
    from .views import SQL_VIEWS

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {SQL_VIEWS} {sql}"
        return f

    return register
