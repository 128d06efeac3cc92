"""What is due: work lists for an outside scheduler, as tables.  Nothing here retrieves anything or raises for a bad request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def created(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Of rows put into a table, those that it did not have; new sites are due for discovery, active or not."""
    return rows.join(table.select(key), key, "left_anti")


def site_work(requests: DataFrame, sites: DataFrame, feeds: DataFrame) -> DataFrame:
    """``website_id, feed_id``: the active feeds of the requested sites ``requests (website_id)``, each once."""
    known = sites.select(F.col("id").alias("website_id"))
    active = feeds.where("active").select("website_id", F.col("id").alias("feed_id"))
    return active.join(requests.select("website_id").join(known, "website_id", "left_semi"), "website_id", "left_semi")


def site_outcomes(requests: DataFrame, sites: DataFrame, feeds: DataFrame) -> DataFrame:
    """``website_id, name, outcome, feeds`` of each request: ``queued``, ``no_active_feeds`` or ``not_found``."""
    names = sites.select(F.col("id").alias("website_id"), "name", F.lit(True).alias("_known"))
    counts = feeds.where("active").groupBy("website_id").agg(F.count("*").alias("_n"))
    rows = requests.select("website_id").join(names, "website_id", "left").join(counts, "website_id", "left")
    known = F.col("_known").isNotNull()
    outcome = F.when(~known, "not_found").when(F.col("_n").isNull(), "no_active_feeds").otherwise("queued")
    queued = F.when(known, F.coalesce("_n", F.lit(0))).otherwise(0).cast("long")
    return rows.select("website_id", "name", outcome.alias("outcome"), queued.alias("feeds"))
