"""Collects queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.sources.tables import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Registers a function under its name; ``sql`` sees the domain tables and the extra ``ctes``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {VIEWS}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add
