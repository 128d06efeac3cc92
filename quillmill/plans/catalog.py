"""All registered queries with the SQL they are held against."""

from __future__ import annotations

from . import aggregates, ingest, parsing, relational, scalars  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
