"""Joins, default orders, pages and deletes over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Declared orders, each closed by the id.
ARTICLE_ORDER = (F.desc_nulls_last, F.desc_nulls_last)


def article_order() -> list:
    return [F.desc_nulls_last("published_date"), F.desc_nulls_last("retrieved_at"), F.asc("id")]


def log_order() -> list:
    return [F.desc_nulls_last("started_at"), F.desc("id")]


def feed_order() -> list:
    return [F.asc("site_name"), F.asc("feed_type"), F.asc("title"), F.asc("id")]


def with_site(feeds: DataFrame, sites: DataFrame) -> DataFrame:
    """Feeds with ``site_name`` and ``site_url``; the planner broadcasts the sites while they are small."""
    return feeds.join(sites.select(F.col("id").alias("website_id"), F.col("name").alias("site_name"), F.col("url").alias("site_url")), "website_id")


def with_feed(rows: DataFrame, feeds: DataFrame, sites: DataFrame) -> DataFrame:
    """Articles or logs with their feed and site."""
    f = with_site(feeds, sites).select(F.col("id").alias("feed_id"), F.col("title").alias("feed_title"), "feed_type", "feed_url", "website_id", "site_name", "site_url")
    return rows.join(f, "feed_id")


def first_of_each(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "position") -> DataFrame:
    """The first ``n`` rows of each group; the plan drops the rest before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def page_numbers(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row on a page of a list: ``total, num_pages, has_previous, has_next, exists``; an empty list has one page."""
    counted = df.agg(F.count("*").alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1).cast("long"))
    counted = counted.select("total", pages.alias("num_pages"))
    known = F.lit(1 <= number) & (F.col("num_pages") >= number)
    return counted.select("total", "num_pages", (known & F.lit(number > 1)).alias("has_previous"), (known & (F.col("num_pages") > number)).alias("has_next"), known.alias("exists"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def cascade_delete(sites: DataFrame, feeds: DataFrame, articles: DataFrame, logs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of the four tables without the sites of ``gone (id)`` and all that hangs on them."""
    lost = feeds.join(gone.select(F.col("id").alias("website_id")), "website_id", "left_semi").select(F.col("id").alias("feed_id"))
    return (
        sites.join(gone, "id", "left_anti"),
        feeds.join(lost, feeds["id"] == lost["feed_id"], "left_anti"),
        articles.join(lost, "feed_id", "left_anti"),
        logs.join(lost, "feed_id", "left_anti"),
    )
