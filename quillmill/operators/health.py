"""Feed health from visit logs: the state machine as windows.

A success sets the error count to zero; a failure adds one and keeps its
message; ``ERROR_LIMIT`` failures in a row switch the feed off, and no success
switches it on again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.sources.schema import ERROR_LIMIT


def feed_health(logs: DataFrame) -> DataFrame:
    """Per feed: last times, current run of errors, its last message, and whether it was ever switched off."""
    w = Window.partitionBy("feed_id").orderBy("started_at", "id")
    ok = F.col("success")
    runs = logs.withColumn("_run", F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fails = F.count(F.when(~ok, 1))
    per_run = runs.groupBy("feed_id", "_run").agg(
        F.max("started_at").alias("seen"), F.max(F.when(ok, F.col("started_at"))).alias("good"), fails.alias("fails"),
        F.max_by("error_message", F.when(~ok, F.struct("started_at", "id"))).alias("message"),
    )
    last = F.max_by(F.struct("fails", "message"), "_run")
    state = per_run.groupBy("feed_id").agg(F.max("seen").alias("last_checked"), F.max("good").alias("last_success"), last.alias("now"), (F.max("fails") >= ERROR_LIMIT).alias("deactivated"))
    return state.select("feed_id", "last_checked", "last_success", F.col("now.fails").alias("error_count"), F.coalesce("now.message", F.lit("")).alias("last_error"), "deactivated")


def health_events(logs: DataFrame, feeds: DataFrame) -> DataFrame:
    """The visits that move a feed's health, as they move it.

    An unexpected exception (``unexpected``) closes its log as failed and leaves
    the feed alone.  Reading a sitemap gives an empty list where it fails, so a
    visit to a sitemap feed always counts as a success.  Visits to unknown feeds
    count as they are.  Works on streams of logs too.
    """
    kinds = feeds.select(F.col("id").alias("_feed"), "feed_type")
    rows = logs.where(~F.coalesce("unexpected", F.lit(False))).join(kinds, F.col("feed_id") == F.col("_feed"), "left")
    ok = F.col("success") | F.coalesce(F.col("feed_type") == "SITEMAP", F.lit(False))
    return rows.withColumn("error_message", F.when(ok, "").otherwise(F.col("error_message"))).withColumn("success", ok).drop("_feed", "feed_type")


def reset_errors(feeds: DataFrame, ids: list[int]) -> DataFrame:
    """Errors cleared for the chosen feeds; they are not switched on."""
    chosen = F.col("id").isin(ids)
    return feeds.withColumn("error_count", F.when(chosen, 0).otherwise(F.col("error_count"))).withColumn("last_error", F.when(chosen, "").otherwise(F.col("last_error")))


def set_active(df: DataFrame, ids: list[int], value: bool) -> DataFrame:
    return df.withColumn("active", F.when(F.col("id").isin(ids), F.lit(value)).otherwise(F.col("active")))
