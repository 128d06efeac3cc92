"""Columns whose names an operator's results would take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keeping_columns(docs: DataFrame, names: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(docs)`` with exactly the columns of ``docs``; those called like one of ``names`` keep their own values."""
    held = {c: f"_qm_own_{c}" for c in docs.columns if c.lower() in names}
    return run(docs.withColumnsRenamed(held)).select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns))
