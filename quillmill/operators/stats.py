"""Counts, rankings and dashboard figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import display_title, feed_label
from quillmill.operators.relations import log_order
from quillmill.sources.schema import FEED_TYPES


def latest(df: DataFrame, column: str) -> Column:
    """The greatest time of a column, as a scalar subquery: the ``as_of`` of data that has no clock."""
    return df.agg(F.max(column)).scalar()


def dashboard_counts(sites: DataFrame, feeds: DataFrame, articles: DataFrame) -> DataFrame:
    counts = [sites.where("active").agg(F.count("*").alias("n")).select(F.lit("active_websites").alias("metric"), "n"), feeds.where("active").agg(F.count("*").alias("n")).select(F.lit("active_feeds").alias("metric"), "n"), articles.agg(F.count("*").alias("n")).select(F.lit("articles").alias("metric"), "n")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def feed_article_counts(articles: DataFrame) -> DataFrame:
    """Articles by feed; shared by all counts, so articles are shuffled once and pre-aggregated."""
    return articles.groupBy("feed_id").agg(F.count("*").alias("article_count"), F.max("published_date").alias("latest_article"))


def feed_article_stats(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    counted = feed_article_counts(articles)
    return feeds.join(counted, feeds["id"] == counted["feed_id"], "left").drop("feed_id").withColumn("article_count", F.coalesce("article_count", F.lit(0)).cast("long"))


def site_counts(sites: DataFrame, feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """Feeds and articles by site.

    ``feed_count_joined`` is the count that two counts over one fan-out join
    give: a feed counts once for each of its articles, and once without any.
    """
    per_feed = feed_article_stats(feeds, articles)
    per_site = per_feed.groupBy("website_id").agg(F.count("*").alias("feed_count"), F.sum("article_count").alias("article_count"), F.sum(F.greatest("article_count", F.lit(1))).alias("feed_count_joined"))
    joined = sites.join(per_site, sites["id"] == per_site["website_id"], "left")
    return joined.select("id", "name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("feed_count", "article_count", "feed_count_joined")))


def articles_per_day(articles: DataFrame, as_of: datetime | Column, days: int) -> DataFrame:
    """One row for each of the ``days`` days before the day of ``as_of``, zeros included."""
    spark: SparkSession = articles.sparkSession
    last = F.to_date(F.lit(as_of))
    calendar = spark.range(max(days, 0)).select(F.date_add(F.date_sub(last, days), F.col("id").cast("int")).alias("day"))
    counted = articles.where((F.to_date("retrieved_at") >= F.date_sub(last, days)) & (F.to_date("retrieved_at") < last)).groupBy(F.to_date("retrieved_at").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def feeds_by_type(feeds: DataFrame) -> DataFrame:
    """Active feeds by label of type, zeros included."""
    kinds = feeds.sparkSession.createDataFrame([(k,) for k in FEED_TYPES], "feed_type string")
    counted = feeds.where("active").groupBy("feed_type").agg(F.count("*").alias("n"))
    return kinds.join(counted, "feed_type", "left").select(feed_label(F.col("feed_type")).alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def top_feeds(feeds: DataFrame, sites: DataFrame, articles: DataFrame, n: int = 5) -> DataFrame:
    best = feed_article_stats(feeds, articles).orderBy(F.desc("article_count"), "id").limit(n)
    names = sites.select(F.col("id").alias("website_id"), F.col("name").alias("website"))
    return best.join(names, "website_id").select("id", display_title(F.col("title"), F.col("feed_url")).alias("title"), "website", "article_count")


def success_rate(feeds: DataFrame, logs: DataFrame, last: int = 20) -> DataFrame:
    """Percent of successes among a feed's last logs; 0 without logs."""
    recent = logs.withColumn("k", F.row_number().over(Window.partitionBy("feed_id").orderBy(*log_order()))).where(F.col("k") <= last)
    rate = recent.groupBy("feed_id").agg((F.avg(F.col("success").cast("int")) * 100).alias("rate"), F.count("*").alias("logs"))
    return feeds.join(rate, feeds["id"] == rate["feed_id"], "left").select("id", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("success_rate"), F.coalesce("logs", F.lit(0)).cast("long").alias("logs"))


def new_content_groups(full: DataFrame, shown: int = 5) -> DataFrame:
    """Size of each (site, type) group of articles and how many a list of ``shown`` leaves out."""
    counted = full.groupBy("site_name", "feed_type").agg(F.count("*").alias("n"))
    return counted.select(F.concat_ws(" - ", "site_name", "feed_type").alias("group_name"), "n", F.greatest(F.col("n") - shown, F.lit(0)).alias("more"))


def date_hierarchy(df: DataFrame, column: str) -> DataFrame:
    """Rows by year, month and day of a time; rolled up from the days."""
    c = F.col(column)
    days = df.where(c.isNotNull()).groupBy(F.date_format(c, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.left("day", F.lit(w)).alias("period")) for k, w in (("year", 4), ("month", 7), ("day", 10)))))
    return days.select(levels.alias("l"), "n").groupBy("l.level", "l.period").agg(F.sum("n").alias("n"))


def request_delays(visits: DataFrame, delay_s: float = 1.0, slot: str = "1 hour") -> DataFrame:
    """Seconds that a polite client would have waited before each request to a host.

    Only a request less than ``delay_s`` before matters, so a host's requests
    are windowed by slots of time, each with what the slot before it ends
    with: a busy host is many groups.
    """
    delay = F.make_dt_interval(secs=F.lit(delay_s).cast("decimal(18,6)"))
    own = F.window("at", slot)["start"]
    later = F.window((F.col("at") + delay).cast("timestamp"), slot)["start"]
    rows = visits.withColumn("at", F.col("at").cast("timestamp")).withColumn("_own", own).withColumn("_later", later)
    each = rows.withColumn("_slot", F.explode(F.array_distinct(F.array("_own", "_later"))))
    w = Window.partitionBy("host", "_slot").orderBy("at", "id")
    gap = (F.unix_micros("at") - F.lag(F.unix_micros("at")).over(w)) / 1e6
    waits = each.withColumn("wait_s", F.coalesce(F.greatest(F.lit(delay_s) - gap, F.lit(0.0)), F.lit(0.0)))
    return waits.where("_slot = _own").drop("_own", "_later", "_slot")


def request_starts(visits: DataFrame, delay_s: float = 1.0, slot: str = "1 hour") -> DataFrame:
    """When a client that keeps ``delay_s`` between its own requests to a host would start each, and how long that waits.

    A wait pushes the requests behind it: ``start(i) = max(at(i), start(i-1) + delay)``,
    which is ``i * delay`` plus the greatest ``at(j) - j * delay`` up to ``i``.  A
    host's requests are numbered and the greatest taken within slots of time, and
    the slots' own numbers carry both over, so a busy host is many groups.  Adds
    ``start_at`` and ``wait_s``; requests at one time go by id.
    """
    delay = round(delay_s * 1_000_000)
    own, earlier = Window.partitionBy("host", "_slot").orderBy("_at", "id"), Window.partitionBy("host").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = visits.withColumn("_at", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("_slot", F.window(F.col("at").cast("timestamp"), slot)["start"])
    rows = rows.withColumn("_k", F.row_number().over(own)).withColumn("_own", F.max(F.col("_at") - F.col("_k") * delay).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    slots = rows.groupBy("host", "_slot").agg(F.count("*").alias("_n"), F.max("_own").alias("_most"))
    slots = slots.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    slots = slots.withColumn("_carried", F.max(F.col("_most") - F.col("_before") * delay).over(earlier)).select(F.col("host").alias("_host"), F.col("_slot").alias("_s"), "_before", "_carried")
    both = rows.join(slots, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_slot") == F.col("_s")))
    start = F.col("_k") * delay + F.greatest(F.col("_own"), F.col("_carried") + F.col("_before") * delay)
    return both.select(*visits.columns, F.timestamp_micros(start).cast("timestamp_ntz").alias("start_at"), ((start - F.col("_at")) / 1e6).alias("wait_s"))


def date_facets(df: DataFrame, column: str, as_of: datetime | Column) -> DataFrame:
    """``facet, value, n``: rows of the day of ``as_of``, of the 7 days up to it, of its month and of its year."""
    day, now = F.to_date(column), F.to_date(F.lit(as_of))
    ranges = {"today": day == now, "past_7_days": (day > F.date_sub(now, 7)) & (day <= now), "this_month": F.trunc(day, "month") == F.trunc(now, "month"), "this_year": F.trunc(day, "year") == F.trunc(now, "year")}
    counted = df.agg(*(F.count_if(test).alias(k) for k, test in ranges.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("value"), F.col(k).alias("n")) for k in ranges))).alias("r")).select(F.lit(column).alias("facet"), "r.value", "r.n")


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def json_report(**parts: DataFrame) -> DataFrame:
    """One row with the parts as JSON arrays of objects, each in the order of its columns.

    For dashboard parts only: each has a bounded number of rows (days, types, a top-k).
    """
    out = None
    for name, df in parts.items():
        row = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias(name)).withColumn("_one", F.lit(1))
        out = row if out is None else out.join(row, "_one")
    return out.drop("_one")
