"""Readers, and the domain's tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file that holds an array of ``{url, name, type}``."""
    return spark.read.schema(schema.MULTI_FEED.elementType).json(path, multiLine=True)


def parse_json_feeds(text: Column) -> Column:
    return F.from_json(text, schema.MULTI_FEED)


def website(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.com")).alias("url"), (F.col("n_nationkey") % 5 != 4).alias("active"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "ATOM").when(F.col("c_mktsegment") == "FURNITURE", "SITEMAP").otherwise("RSS")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("website_id"),
        F.concat(F.lit("https://feeds.example.com/"), F.col("c_custkey").cast("string")).alias("feed_url"), kind.alias("feed_type"),
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("title"), (F.col("c_acctbal") >= 0).alias("active"),
    )


def article(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = F.col("o_orderkey")
    return o.join(d, key == F.col("doc_id"), "left").select(
        # Feeds whose id ends in 0 have no articles: theirs go to the feed before.
        key.alias("id"), (F.col("o_custkey") - F.when(F.col("o_custkey") % 10 == 0, 1).otherwise(0)).alias("feed_id"),
        F.concat(F.lit("https://example.com/a/story-"), key.cast("string"), F.when(key % 3 == 0, "/").otherwise("")).alias("url"),
        F.coalesce(F.substring("text", 1, 80), F.lit("Untitled")).alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.coalesce(F.substring("text", 1, 200), F.lit("")).alias("summary"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("author"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate")).alias("published_date"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 72).cast("int"))).alias("retrieved_at"),
    )


def visit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    took = F.make_dt_interval(secs=(F.col("event_id") % 900 / 10).cast("decimal(18,6)"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("feed_id"), F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 11 != 0, F.col("ts") + took).alias("completed_at"), (kind != "error").alias("success"),
        F.when(kind == "signup", F.floor("value").cast("int")).otherwise(0).alias("new_articles"),
        F.when(kind == "error", F.concat(F.lit("Network error: "), "props")).otherwise("").alias("error_message"),
    )


#: The same tables for SQL.
VIEWS = """
website AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, concat('https://', lower(n_name), '.example.com') AS url, n_nationkey % 5 <> 4 AS active FROM nation
), feed AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS website_id, concat('https://feeds.example.com/', CAST(c_custkey AS STRING)) AS feed_url,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'ATOM' WHEN 'FURNITURE' THEN 'SITEMAP' ELSE 'RSS' END AS feed_type,
         CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS title, c_acctbal >= 0 AS active
  FROM customer
), article AS (
  SELECT o.o_orderkey AS id, o.o_custkey - CASE WHEN o.o_custkey % 10 = 0 THEN 1 ELSE 0 END AS feed_id,
         concat('https://example.com/a/story-', CAST(o.o_orderkey AS STRING), CASE WHEN o.o_orderkey % 3 = 0 THEN '/' ELSE '' END) AS url,
         coalesce(substring(d.text, 1, 80), 'Untitled') AS title, coalesce(d.text, '') AS content, coalesce(substring(d.text, 1, 200), '') AS summary,
         CASE WHEN o.o_orderstatus = 'P' THEN '' ELSE o.o_orderpriority END AS author,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o.o_orderdate END AS published_date,
         o.o_orderdate + INTERVAL '1' HOUR * CAST(o.o_orderkey % 72 AS INT) AS retrieved_at
  FROM orders o LEFT JOIN documents d ON d.doc_id = o.o_orderkey
), visit_log AS (
  SELECT event_id AS id, user_id AS feed_id, ts AS started_at,
         CASE WHEN event_id % 11 <> 0 THEN ts + INTERVAL '100' MILLISECOND * CAST(event_id % 900 AS INT) END AS completed_at,
         event_type <> 'error' AS success, CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS INT) ELSE 0 END AS new_articles,
         CASE WHEN event_type = 'error' THEN concat('Network error: ', props) ELSE '' END AS error_message
  FROM events
), feed_status AS (
  SELECT feed_id, max(started_at) AS last_checked, max(CASE WHEN success THEN started_at END) AS last_success,
         CAST(sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
         coalesce(arg_max(error_message, (started_at, id)) FILTER (WHERE g = 0), '') AS last_error
  FROM (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY started_at DESC, id DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM visit_log) t
  GROUP BY feed_id
)
"""
