"""Ranges of ids: bounds from quantiles, and the range of a row by SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_bounds(rows: DataFrame, column: str, ranges: int) -> tuple[list[int], int | None]:
    """At most ``ranges - 1`` ids that cut the rows into ranges of like size, and the greatest id."""
    cuts = [k / ranges for k in range(1, ranges)]
    high, found = rows.agg(F.max(column), F.percentile_approx(column, cuts, 20 * ranges) if cuts else F.lit(None).cast("array<bigint>")).first()
    return sorted({x for x in found or [] if x < high}), high


def with_range(rows: DataFrame, column: str, bounds: list[int], name: str) -> DataFrame:
    """Adds ``name``: how many bounds are below the id, by binary search; 0 for null."""
    rows = rows.withColumn(name, F.lit(0))
    known = F.lit(bounds)
    for k in reversed(range(len(bounds).bit_length())):
        ahead = F.col(name) + (1 << k)
        rows = rows.withColumn(name, F.when((ahead <= len(bounds)) & (F.get(known, ahead - 1) < F.col(column)), ahead).otherwise(F.col(name)))
    return rows
