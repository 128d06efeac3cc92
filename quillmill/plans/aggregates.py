"""Counts, top-k, groups and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.urls import host
from quillmill.operators import filters, relations, stats
from quillmill.operators.health import feed_health, health_events
from quillmill.sources import tables as t

from .registry import query
from .relational import ARTICLE_FULL, error_feeds, full_articles


@query("SELECT 'active_websites' AS metric, count(*) AS n FROM website WHERE active UNION ALL SELECT 'active_feeds', count(*) FROM feed WHERE active UNION ALL SELECT 'articles', count(*) FROM article")
def dashboard_counts(spark, d):
    return stats.dashboard_counts(t.website(spark, d), t.feed(spark, d), t.article(spark, d))


@query("SELECT w.id, w.name, count(DISTINCT f.id) AS feed_count, count(DISTINCT a.id) AS article_count FROM website w LEFT JOIN feed f ON f.website_id = w.id LEFT JOIN article a ON a.feed_id = f.id GROUP BY w.id, w.name")
def site_counts(spark, d):
    return stats.site_counts(t.website(spark, d), t.feed(spark, d), t.article(spark, d)).drop("feed_count_joined")


@query("SELECT w.id, w.name, count(f.id) AS feed_count, count(a.id) AS article_count FROM website w LEFT JOIN feed f ON f.website_id = w.id LEFT JOIN article a ON a.feed_id = f.id GROUP BY w.id, w.name")
def site_counts_compat(spark, d):
    counts = stats.site_counts(t.website(spark, d), t.feed(spark, d), t.article(spark, d))
    return counts.select("id", "name", F.col("feed_count_joined").alias("feed_count"), "article_count")


@query("SELECT f.id, count(a.id) AS article_count, max(a.published_date) AS latest_article FROM feed f LEFT JOIN article a ON a.feed_id = f.id GROUP BY f.id")
def feed_article_stats(spark, d):
    return stats.feed_article_stats(t.feed(spark, d), t.article(spark, d)).select("id", "article_count", "latest_article")


@query(
    """SELECT strftime(c.day, '%Y-%m-%d') AS date, count(a.id) AS count
       FROM (SELECT CAST((SELECT max(retrieved_at) FROM article) AS DATE) - CAST(k AS INT) AS day FROM range(1, 31) r(k)) c
       LEFT JOIN article a ON CAST(a.retrieved_at AS DATE) = c.day GROUP BY c.day"""
)
def articles_per_day(spark, d):
    a = t.article(spark, d)
    return stats.articles_per_day(a, stats.latest(a, "retrieved_at"), 30)


@query(
    """SELECT k.label, count(f.id) AS count FROM (VALUES ('RSS', 'RSS Feed'), ('ATOM', 'Atom Feed'), ('SITEMAP', 'Sitemap')) AS k(code, label)
       LEFT JOIN feed f ON f.feed_type = k.code AND f.active GROUP BY k.label"""
)
def feeds_by_type(spark, d):
    return stats.feeds_by_type(t.feed(spark, d))


@query(
    """SELECT f.id, CASE WHEN f.title = '' THEN f.feed_url ELSE f.title END AS title, w.name AS website, c.n AS article_count
       FROM (SELECT f.id, count(a.id) AS n FROM feed f LEFT JOIN article a ON a.feed_id = f.id GROUP BY f.id ORDER BY n DESC, f.id LIMIT 5) c JOIN feed f ON f.id = c.id JOIN website w ON w.id = f.website_id"""
)
def top_feeds(spark, d):
    return stats.top_feeds(t.feed(spark, d), t.website(spark, d), t.article(spark, d))


@query(
    """SELECT f.id, round(coalesce(avg(CAST(l.success AS INT)) * 100, 0), 6) AS success_rate, count(l.id) AS logs FROM feed f
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY started_at DESC, id DESC) AS k FROM visit_log) l ON l.feed_id = f.id AND l.k <= 20 GROUP BY f.id"""
)
def success_rate(spark, d):
    return stats.success_rate(t.feed(spark, d), t.visit_log(spark, d))


RECENT_SQL = f"full_article AS ({ARTICLE_FULL}), fresh AS (SELECT * FROM full_article WHERE retrieved_at >= (SELECT max(retrieved_at) FROM article) - INTERVAL '1000' DAY)"


def fresh(spark, d):
    rows = full_articles(spark, d)
    return filters.since(rows, "retrieved_at", stats.latest(t.article(spark, d), "retrieved_at"), days=1000)


@query("SELECT concat(site_name, ' - ', feed_type) AS group_name, count(*) AS n, greatest(count(*) - 5, 0) AS more FROM fresh GROUP BY site_name, feed_type", RECENT_SQL)
def new_content_groups(spark, d):
    return stats.new_content_groups(fresh(spark, d))


@query(
    """SELECT site_name, feed_type, id, position, shown_at, short_title FROM (SELECT site_name, feed_type, id, strftime(coalesce(published_date, retrieved_at), '%Y-%m-%d %H:%M') AS shown_at, substring(title, 1, 80) AS short_title,
       CAST(row_number() OVER (PARTITION BY site_name, feed_type ORDER BY retrieved_at DESC, id) AS INT) AS position FROM fresh) WHERE position <= 5""",
    RECENT_SQL,
)
def new_content_top5(spark, d):
    rows = fresh(spark, d).select("site_name", "feed_type", "id", "retrieved_at", "published_date", "title")
    best = relations.first_of_each(rows, ["site_name", "feed_type"], [F.desc("retrieved_at"), "id"], 5)
    return best.select("site_name", "feed_type", "id", "position", F.date_format(F.coalesce("published_date", "retrieved_at"), "yyyy-MM-dd HH:mm").alias("shown_at"), F.substring("title", 1, 80).alias("short_title"))


@query("SELECT feed_id, id, position FROM (SELECT feed_id, id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY published_date DESC NULLS LAST, retrieved_at DESC NULLS LAST, id) AS INT) AS position FROM article) WHERE position <= 20")
def feed_recent_articles(spark, d):
    rows = t.article(spark, d).select("feed_id", "id", "published_date", "retrieved_at")
    return relations.first_of_each(rows, ["feed_id"], relations.article_order(), 20).select("feed_id", "id", "position")


@query("SELECT feed_id, id, position FROM (SELECT feed_id, id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY started_at DESC, id DESC) AS INT) AS position FROM visit_log) WHERE position <= 10")
def feed_recent_logs(spark, d):
    rows = t.visit_log(spark, d).select("feed_id", "id", "started_at")
    return relations.first_of_each(rows, ["feed_id"], relations.log_order(), 10).select("feed_id", "id", "position")


@query(
    """SELECT website_id, id, position FROM (SELECT f.website_id, a.id, CAST(row_number() OVER (PARTITION BY f.website_id ORDER BY a.published_date DESC NULLS LAST, a.retrieved_at DESC NULLS LAST, a.id) AS INT) AS position
       FROM article a JOIN feed f ON f.id = a.feed_id) WHERE position <= 10"""
)
def site_recent_articles(spark, d):
    feeds = t.feed(spark, d).select(F.col("id").alias("feed_id"), "website_id")
    rows = t.article(spark, d).select("feed_id", "id", "published_date", "retrieved_at").join(feeds, "feed_id")
    return relations.first_of_each(rows, ["website_id"], relations.article_order(), 10).select("website_id", "id", "position")


@query(
    """SELECT 'year' AS level, strftime(published_date, '%Y') AS period, count(*) AS n FROM article WHERE published_date IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'month', strftime(published_date, '%Y-%m'), count(*) FROM article WHERE published_date IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'day', strftime(published_date, '%Y-%m-%d'), count(*) FROM article WHERE published_date IS NOT NULL GROUP BY 2"""
)
def date_hierarchy(spark, d):
    return stats.date_hierarchy(t.article(spark, d), "published_date")


@query("SELECT feed_id, last_checked, last_success, error_count, last_error FROM feed_status")
def health_error_count(spark, d):
    return feed_health(t.visit_log(spark, d)).select("feed_id", "last_checked", "last_success", "error_count", "last_error")


@query(
    """SELECT feed_id, max(fails) >= 5 AS deactivated FROM (SELECT feed_id, run, count(*) FILTER (WHERE NOT success) AS fails FROM
       (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY feed_id ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM visit_log) GROUP BY feed_id, run) GROUP BY feed_id"""
)
def health_deactivated(spark, d):
    return feed_health(t.visit_log(spark, d)).select("feed_id", "deactivated")


@query(
    """SELECT id, round(coalesce(greatest(1.0 - (epoch_us(req) - lag(epoch_us(req)) OVER (PARTITION BY host ORDER BY req, id)) / 1000000.0, 0.0), 0.0), 6) AS wait_s
       FROM (SELECT page_id AS id, regexp_extract(url, '://([^/?#]+)', 1) AS host, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '250' MILLISECOND * CAST(page_id AS INT) AS req FROM pages)"""
)
def rate_limit_delay(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    visits = t.table(spark, d, "pages").select(F.col("page_id").alias("id"), host(F.col("url")).alias("host"), (start + F.make_dt_interval(secs=(F.col("page_id") / 4).cast("decimal(18,6)"))).alias("at"))
    return stats.request_delays(visits).select("id", F.round("wait_s", 6).alias("wait_s"))


@query(
    """SELECT id, make_timestamp(s) AS start_at, round((s - us) / 1000000.0, 6) AS wait_s FROM (
         SELECT id, us, k * 1000000 + max(us - k * 1000000) OVER (PARTITION BY host ORDER BY k) AS s FROM (
           SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, id) AS k FROM (
             SELECT page_id AS id, regexp_extract(url, '://([^/?#]+)', 1) AS host, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '100' MILLISECOND * CAST(page_id AS INT)) AS us FROM pages)))"""
)
def request_starts(spark, d):
    """Start of each request to a host when a wait pushes the ones behind it."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    visits = t.table(spark, d, "pages").select(F.col("page_id").alias("id"), host(F.col("url")).alias("host"), (start + F.make_dt_interval(secs=(F.col("page_id") / 10).cast("decimal(18,6)"))).alias("at"))
    return stats.request_starts(visits, slot="1 minute").select("id", "start_at", F.round("wait_s", 6).alias("wait_s"))


_MOVES = """moves AS (
  SELECT l.id, l.feed_id, l.started_at, l.success OR coalesce(f.feed_type = 'SITEMAP', false) AS success, l.error_message
  FROM visit_log l LEFT JOIN feed f ON f.id = l.feed_id WHERE NOT (NOT l.success AND l.completed_at IS NULL)
), runs AS (
  SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY feed_id ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM moves
), ends AS (
  SELECT feed_id, run, max(started_at) AS seen, count(*) FILTER (WHERE NOT success) AS fails, arg_max(error_message, (started_at, id)) FILTER (WHERE NOT success) AS message FROM runs GROUP BY feed_id, run
)"""


def health_moves(spark: SparkSession, d: str) -> DataFrame:
    """Visits with what moves health: a failure that never completed was an unexpected exception."""
    logs = t.visit_log(spark, d)
    return health_events(logs.withColumn("unexpected", ~F.col("success") & F.col("completed_at").isNull()), t.feed(spark, d))


@query("SELECT feed_id, max(seen) AS last_checked, arg_max(fails, run) AS error_count, coalesce(arg_max(coalesce(message, ''), run), '') AS last_error, max(fails) >= 5 AS deactivated FROM ends GROUP BY feed_id", _MOVES)
def health_by_kind(spark, d):
    """Health where sitemap feeds never fail and unexpected exceptions don't count."""
    return feed_health(health_moves(spark, d)).select("feed_id", "last_checked", "error_count", "last_error", "deactivated")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_first(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return stats.first_wins(docs, "text_hash", ["doc_id"]).select("doc_id")


@query(
    """SELECT (SELECT to_json(list_sort(list(p))) FROM (SELECT {'date': strftime(c.day, '%Y-%m-%d'), 'count': count(a.id)} AS p
                 FROM (SELECT CAST((SELECT max(retrieved_at) FROM article) AS DATE) - CAST(k AS INT) AS day FROM range(1, 8) r(k)) c LEFT JOIN article a ON CAST(a.retrieved_at AS DATE) = c.day GROUP BY c.day)) AS new_articles_by_day,
              (SELECT to_json(list_sort(list({'label': label, 'count': n}))) FROM by_type) AS feeds_by_type, (SELECT to_json(list_sort(list({'id': id, 'title': title, 'website': website, 'article_count': article_count}))) FROM best) AS top_feeds,
              (SELECT to_json(list_sort(list({'id': id, 'title': title, 'website': website, 'error_count': error_count}))) FROM wrong) AS error_feeds""",
    """by_type AS (SELECT k.label, count(f.id) AS n FROM (VALUES ('RSS', 'RSS Feed'), ('ATOM', 'Atom Feed'), ('SITEMAP', 'Sitemap')) AS k(code, label) LEFT JOIN feed f ON f.feed_type = k.code AND f.active GROUP BY k.label),
    best AS (SELECT f.id, CASE WHEN f.title = '' THEN f.feed_url ELSE f.title END AS title, w.name AS website, c.n AS article_count
             FROM (SELECT f.id, count(a.id) AS n FROM feed f LEFT JOIN article a ON a.feed_id = f.id GROUP BY f.id ORDER BY n DESC, f.id LIMIT 5) c JOIN feed f ON f.id = c.id JOIN website w ON w.id = f.website_id),
    wrong AS (SELECT f.id, f.title, w.name AS website, s.error_count FROM feed f JOIN website w ON w.id = f.website_id JOIN feed_status s ON s.feed_id = f.id WHERE s.error_count > 0 AND f.active ORDER BY w.name, f.feed_type, f.title, f.id LIMIT 5)""",
)
def stats_report(spark, d):
    """The dashboard's four parts in one row of JSON."""
    sites, feeds, a = t.website(spark, d), t.feed(spark, d), t.article(spark, d)
    return stats.json_report(new_articles_by_day=stats.articles_per_day(a, stats.latest(a, "retrieved_at"), 7), feeds_by_type=stats.feeds_by_type(feeds), top_feeds=stats.top_feeds(feeds, sites, a), error_feeds=error_feeds(spark, d))


@query(
    """SELECT 'website_id' AS facet, CAST(f.website_id AS VARCHAR) AS value, count(*) AS n FROM article a JOIN feed f ON f.id = a.feed_id GROUP BY f.website_id
       UNION ALL SELECT 'feed_id', CAST(feed_id AS VARCHAR), count(*) FROM article GROUP BY feed_id
       UNION ALL SELECT 'retrieved_at', 'today', count(*) FILTER (WHERE CAST(retrieved_at AS DATE) = today) FROM article, now GROUP BY ALL
       UNION ALL SELECT 'retrieved_at', 'past_7_days', count(*) FILTER (WHERE CAST(retrieved_at AS DATE) > today - 7) FROM article, now
       UNION ALL SELECT 'retrieved_at', 'this_month', count(*) FILTER (WHERE date_trunc('month', retrieved_at) = date_trunc('month', today)) FROM article, now
       UNION ALL SELECT 'retrieved_at', 'this_year', count(*) FILTER (WHERE year(retrieved_at) = year(today)) FROM article, now""",
    "now AS (SELECT CAST(max(retrieved_at) AS DATE) AS today FROM article)",
)
def article_facets(spark, d):
    a = t.article(spark, d)
    named = a.select("feed_id").join(t.feed(spark, d).select(F.col("id").alias("feed_id"), "website_id"), "feed_id")
    return filters.facets(named, "website_id").unionAll(filters.facets(a, "feed_id")).unionAll(stats.date_facets(a, "retrieved_at", stats.latest(a, "retrieved_at")))


@query(
    """SELECT 'success' AS facet, CAST(success AS VARCHAR) AS value, count(*) AS n FROM visit_log GROUP BY success UNION ALL SELECT 'feed_id', CAST(feed_id AS VARCHAR), count(*) FROM visit_log GROUP BY feed_id
       UNION ALL SELECT 'website_id', CAST(f.website_id AS VARCHAR), count(*) FROM visit_log l JOIN feed f ON f.id = l.feed_id GROUP BY f.website_id
       UNION ALL SELECT 'started_at', 'today', count(*) FILTER (WHERE CAST(started_at AS DATE) = today) FROM visit_log, now
       UNION ALL SELECT 'started_at', 'past_7_days', count(*) FILTER (WHERE CAST(started_at AS DATE) > today - 7) FROM visit_log, now
       UNION ALL SELECT 'started_at', 'this_month', count(*) FILTER (WHERE date_trunc('month', started_at) = date_trunc('month', today)) FROM visit_log, now
       UNION ALL SELECT 'started_at', 'this_year', count(*) FILTER (WHERE year(started_at) = year(today)) FROM visit_log, now""",
    "now AS (SELECT CAST(max(started_at) AS DATE) AS today FROM visit_log)",
)
def log_facets(spark, d):
    logs = t.visit_log(spark, d)
    named = logs.select("feed_id").join(t.feed(spark, d).select(F.col("id").alias("feed_id"), "website_id"), "feed_id")
    return filters.facets(logs, "success", "feed_id").unionAll(filters.facets(named, "website_id")).unionAll(stats.date_facets(logs, "started_at", stats.latest(logs, "started_at")))


@query(
    """SELECT number, total, num_pages, number > 1 AND number <= num_pages AS has_previous, number < num_pages AS has_next, number <= num_pages AS "exists"
       FROM (SELECT CAST(n AS INT) AS number, count(*) AS total, greatest(CAST(ceil(count(*) / 25.0) AS BIGINT), 1) AS num_pages FROM article, (VALUES (1), (3), (1000000)) AS p(n) GROUP BY n)"""
)
def page_totals(spark, d):
    a = t.article(spark, d)
    parts = [relations.page_numbers(a, n, 25).select(F.lit(n).alias("number"), "*") for n in (1, 3, 1_000_000)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    """SELECT site_name, feed_type, count(*) AS n FROM full_article WHERE retrieved_at >= (SELECT max(retrieved_at) FROM article) - INTERVAL '24000' HOUR AND (contains(lower(site_name), 'n_1') OR contains(lower(site_url), 'n_1')) GROUP BY site_name, feed_type""",
    f"full_article AS ({ARTICLE_FULL})",
)
def new_content_of_sites(spark, d):
    """New articles of the sites that a name or URL names, by site and type."""
    rows = filters.new_content(full_articles(spark, d), stats.latest(t.article(spark, d), "retrieved_at"), 24_000, "N_1")
    return rows.groupBy("site_name", "feed_type").agg(F.count("*").alias("n"))
