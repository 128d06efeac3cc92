"""Scans, filters, joins, orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import minute, stored_hash
from quillmill.operators import filters, relations, stats
from quillmill.operators.health import feed_health
from quillmill.operators.ingest import backfill_batch
from quillmill.operators.search_index import TrigramIndex
from quillmill.sources import tables as t
from quillmill.sources.stage import Stage

from .registry import query

ARTICLE_FULL = "SELECT a.*, f.title AS feed_title, f.feed_type, f.feed_url, f.website_id, w.name AS site_name, w.url AS site_url FROM article a JOIN feed f ON f.id = a.feed_id JOIN website w ON w.id = f.website_id"


def full_articles(spark: SparkSession, d: str) -> DataFrame:
    return relations.with_feed(t.article(spark, d), t.feed(spark, d), t.website(spark, d))


def site_feed(spark: SparkSession, d: str) -> DataFrame:
    return relations.with_site(t.feed(spark, d), t.website(spark, d))


def feed_state(spark: SparkSession, d: str) -> DataFrame:
    """Feeds with their site and health; feeds without logs have no health."""
    h = feed_health(t.visit_log(spark, d))
    f = site_feed(spark, d)
    return f.join(h, f["id"] == h["feed_id"], "left").drop("feed_id").withColumn("error_count", F.coalesce("error_count", F.lit(0)))


@query("SELECT id, name, url, active FROM website")
def scan_website(spark, d):
    return t.website(spark, d)


@query("SELECT id, name, url, active FROM website WHERE id = 7")
def point_lookup(spark, d):
    return filters.lookup(t.website(spark, d), "id", 7)


@query("SELECT id, name, url FROM website WHERE contains(lower(name), '_1') OR contains(lower(url), '_1')")
def search_website(spark, d):
    return filters.search(t.website(spark, d), "_1", "name", "url").select("id", "name", "url")


@query("SELECT f.id, f.title, w.name AS site_name FROM feed f JOIN website w ON w.id = f.website_id WHERE contains(lower(f.title), '11') OR contains(lower(f.feed_url), '11') OR contains(lower(w.name), '11')")
def search_feed(spark, d):
    return filters.search(site_feed(spark, d), "11", "title", "feed_url", "site_name").select("id", "title", "site_name")


@query("SELECT id, url FROM article WHERE contains(lower(title), 'high') OR contains(lower(summary), 'high') OR contains(lower(author), 'high')")
def search_article(spark, d):
    return filters.search(t.article(spark, d), "High", "title", "summary", "author").select("id", "url")


@query("SELECT id, url FROM article WHERE contains(lower(title), 'high') OR contains(lower(summary), 'high') OR contains(lower(author), 'high')")
def index_search_article(spark, d):
    """The same search through a trigram index."""
    articles = t.article(spark, d)
    index = TrigramIndex(spark, Stage(spark, "index").path, "id", ("title", "summary", "author")).add(articles)
    return index.search(articles, "High").select("id", "url")


_ALL_FIELDS = " AND ".join(f"(contains(lower(title), '{q}') OR contains(lower(content), '{q}') OR contains(lower(author), '{q}') OR contains(lower(url), '{q}'))" for q in ("high", "-12", "5"))


@query(f"SELECT id, url FROM article WHERE {_ALL_FIELDS}")
def index_admin_search(spark, d):
    """Articles with all terms, each in some field, through a trigram index over whole texts; one term is too short for it."""
    articles = t.article(spark, d)
    index = TrigramIndex(spark, Stage(spark, "index").path, "id", ("title", "content", "author", "url")).add(articles)
    return index.search_terms(articles, "High -12 5").select("id", "url")


@query("SELECT id, feed_url FROM feed WHERE website_id = 3")
def filter_fk(spark, d):
    return t.feed(spark, d).where(F.col("website_id") == 3).select("id", "feed_url")


@query("SELECT a.id, a.url FROM article a JOIN feed f ON f.id = a.feed_id WHERE f.website_id = 3")
def filter_fk_join(spark, d):
    feeds = t.feed(spark, d).where(F.col("website_id") == 3).select(F.col("id").alias("feed_id"))
    return t.article(spark, d).join(feeds, "feed_id").select("id", "url")


@query("SELECT id, feed_url FROM feed WHERE feed_type = 'ATOM'")
def filter_type(spark, d):
    return t.feed(spark, d).where(F.col("feed_type") == "ATOM").select("id", "feed_url")


@query("SELECT 'true' AS choice, id FROM feed WHERE active UNION ALL SELECT 'false', id FROM feed WHERE NOT active UNION ALL SELECT 'any', id FROM feed")
def filter_active(spark, d):
    feeds = t.feed(spark, d)
    parts = [filters.active_filter(feeds, c).select(F.lit(c).alias("choice"), "id") for c in ("true", "false", "any")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT id, published_date FROM article WHERE published_date >= TIMESTAMP '1996-01-01 00:00:00' AND published_date <= TIMESTAMP '1996-03-01 00:00:00'")
def date_range(spark, d):
    return filters.date_range(t.article(spark, d), "published_date", "1996-01-01", "1996-03-01").select("id", "published_date")


@query("SELECT id, url FROM article WHERE retrieved_at >= (SELECT max(retrieved_at) FROM article) - INTERVAL '7' DAY")
def recent_7d(spark, d):
    a = t.article(spark, d)
    return filters.since(a, "retrieved_at", stats.latest(a, "retrieved_at"), days=7).select("id", "url")


@query("SELECT id, url FROM article WHERE retrieved_at >= (SELECT max(retrieved_at) FROM article) - INTERVAL '24' HOUR")
def recent_24h(spark, d):
    a = t.article(spark, d)
    return filters.since(a, "retrieved_at", stats.latest(a, "retrieved_at"), hours=24).select("id", "url")


@query("SELECT id, feed_url FROM feed WHERE active")
def active_feeds(spark, d):
    return t.feed(spark, d).where("active").select("id", "feed_url")


@query("SELECT id, name FROM website WHERE active")
def active_sites(spark, d):
    return t.website(spark, d).where("active").select("id", "name")


@query("SELECT f.id, f.title, w.name AS website, s.error_count FROM feed f JOIN website w ON w.id = f.website_id JOIN feed_status s ON s.feed_id = f.id WHERE s.error_count > 0 AND f.active ORDER BY w.name, f.feed_type, f.title, f.id LIMIT 5")
def error_feeds(spark, d):
    rows = feed_state(spark, d).where("error_count > 0 AND active").orderBy(*relations.feed_order()).limit(5)
    return rows.select("id", "title", F.col("site_name").alias("website"), "error_count")


@query("SELECT id, url FROM article WHERE content IS NULL OR content = ''")
def missing_content(spark, d):
    return filters.missing_content(t.article(spark, d)).select("id", "url")


@query("SELECT a.id FROM article a JOIN feed f ON f.id = a.feed_id WHERE a.content = '' AND f.feed_type = 'SITEMAP'")
def missing_sitemap(spark, d):
    feeds = t.feed(spark, d).where("feed_type = 'SITEMAP'").select(F.col("id").alias("feed_id"))
    return filters.missing_content(t.article(spark, d)).join(feeds, "feed_id").select("id")


@query("SELECT a.id FROM article a JOIN feed f ON f.id = a.feed_id WHERE a.content = '' AND f.feed_type <> 'SITEMAP'")
def missing_other(spark, d):
    feeds = t.feed(spark, d).where("feed_type <> 'SITEMAP'").select(F.col("id").alias("feed_id"))
    return filters.missing_content(t.article(spark, d)).join(feeds, "feed_id").select("id")


@query("SELECT a.id, w.name AS site_name FROM article a JOIN feed f ON f.id = a.feed_id JOIN website w ON w.id = f.website_id WHERE a.content = '' AND contains(lower(w.name), 'n_1')")
def missing_by_site(spark, d):
    return filters.missing_content(filters.search(full_articles(spark, d), "N_1", "site_name")).select("id", "site_name")


@query("SELECT a.id FROM article a JOIN feed f ON f.id = a.feed_id WHERE a.content = '' AND f.feed_type = 'SITEMAP' ORDER BY a.id LIMIT 100")
def missing_batch(spark, d):
    return backfill_batch(full_articles(spark, d)).select("id")


@query("SELECT id FROM article WHERE feed_id IN (SELECT id FROM feed WHERE website_id IN (SELECT id FROM website WHERE contains(lower(name), '_2')))")
def semi_in(spark, d):
    sites = filters.search(t.website(spark, d), "_2", "name").select(F.col("id").alias("website_id"))
    feeds = t.feed(spark, d).join(sites, "website_id", "left_semi").select(F.col("id").alias("feed_id"))
    return t.article(spark, d).join(feeds, "feed_id", "left_semi").select("id")


@query(
    """SELECT f.id, w.name AS site_name, coalesce(strftime(s.last_checked, '%Y-%m-%d %H:%M'), 'Never') AS seen,
       row_number() OVER (ORDER BY w.name, f.feed_type, f.title, f.id) <= 10 AS shown
       FROM feed f JOIN website w ON w.id = f.website_id LEFT JOIN feed_status s ON s.feed_id = f.id
       WHERE f.active AND (s.last_checked IS NULL OR s.last_checked < (SELECT max(started_at) FROM visit_log) - INTERVAL '24' HOUR)"""
)
def stale_feeds(spark, d):
    before = stats.latest(t.visit_log(spark, d), "started_at") - F.make_dt_interval(hours=F.lit(24))
    rows = filters.stale(feed_state(spark, d), before)
    first = rows.orderBy(*relations.feed_order()).limit(10).select("id", F.lit(True).alias("shown"))
    return rows.select("id", "site_name", minute(F.col("last_checked")).alias("seen")).join(first, "id", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


@query(
    """SELECT b.id FROM (SELECT id, url, CASE WHEN content = '' THEN '' ELSE sha256(concat(title, CASE WHEN id % 2 = 0 THEN concat(content, '!') ELSE content END, summary)) END AS h FROM article) b
       WHERE EXISTS (SELECT 1 FROM (SELECT url, CASE WHEN content = '' THEN '' ELSE sha256(concat(title, content, summary)) END AS h FROM article) a WHERE a.url = b.url AND a.h = b.h)"""
)
def exists_same_content(spark, d):
    a = t.article(spark, d)
    hashed = a.select("url", stored_hash(F.col("title"), F.col("content"), F.col("summary")).alias("content_hash"))
    changed = F.when((F.col("id") % 2 == 0) & (F.col("content") != ""), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    batch = a.select("id", "url", stored_hash(F.col("title"), changed, F.col("summary")).alias("content_hash"))
    return filters.same_content(batch, hashed).select("id")


@query("SELECT id, length(concat(url, repeat('x', CAST(id % 2500 AS INT)))) AS n FROM article WHERE length(concat(url, repeat('x', CAST(id % 2500 AS INT)))) > 2048")
def url_too_long(spark, d):
    long = F.concat("url", F.repeat(F.lit("x"), (F.col("id") % 2500).cast("int")))
    return t.article(spark, d).select("id", F.char_length(long).cast("long").alias("n")).where("n > 2048")


@query(
    """SELECT 'website' AS entity, id FROM website WHERE (contains(lower(name), 'a') OR contains(lower(url), 'a')) AND (contains(lower(name), 'n') OR contains(lower(url), 'n'))
       UNION ALL SELECT 'feed', f.id FROM feed f JOIN website w ON w.id = f.website_id WHERE (contains(lower(f.title), '1') OR contains(lower(f.feed_url), '1') OR contains(lower(w.name), '1')) AND (contains(lower(f.title), 'na') OR contains(lower(f.feed_url), 'na') OR contains(lower(w.name), 'na'))
       UNION ALL SELECT 'article', id FROM article WHERE (contains(lower(title), 'high') OR contains(lower(content), 'high') OR contains(lower(author), 'high') OR contains(lower(url), 'high')) AND (contains(lower(title), '-12') OR contains(lower(content), '-12') OR contains(lower(author), '-12') OR contains(lower(url), '-12'))
       UNION ALL SELECT 'log', l.id FROM visit_log l JOIN feed f ON f.id = l.feed_id WHERE (contains(lower(f.title), 'network') OR contains(lower(f.feed_url), 'network') OR contains(lower(l.error_message), 'network')) AND (contains(lower(f.title), '12') OR contains(lower(f.feed_url), '12') OR contains(lower(l.error_message), '12'))"""
)
def admin_search(spark, d):
    logs = relations.with_feed(t.visit_log(spark, d), t.feed(spark, d), t.website(spark, d))
    parts = {
        "website": filters.search_terms(t.website(spark, d), "a n", "name", "url"),
        "feed": filters.search_terms(site_feed(spark, d), "1 NA", "title", "feed_url", "site_name"),
        "article": filters.search_terms(t.article(spark, d), "high -12", "title", "content", "author", "url"),
        "log": filters.search_terms(logs, "network 12", "feed_title", "feed_url", "error_message"),
    }
    named = [df.select(F.lit(k).alias("entity"), "id") for k, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionAll(df)
    return out


@query(
    """SELECT 'feed_type' AS facet, feed_type AS value, count(*) AS n FROM feed GROUP BY feed_type UNION ALL SELECT 'active', CAST(active AS VARCHAR), count(*) FROM feed GROUP BY active
       UNION ALL SELECT 'website_id', CAST(website_id AS VARCHAR), count(*) FROM feed GROUP BY website_id"""
)
def facet_counts(spark, d):
    return filters.facets(t.feed(spark, d), "feed_type", "active", "website_id")


@query(
    """SELECT term, id, name FROM (SELECT t.term, w.id, w.name, row_number() OVER (PARTITION BY t.term ORDER BY CASE WHEN contains(lower(w.name), lower(t.term)) THEN 0 ELSE 1 END, w.name, w.id) AS k
       FROM (VALUES ('n_1'), ('nation_7.example'), ('nothing')) AS t(term) JOIN website w ON contains(lower(w.name), lower(t.term)) OR contains(lower(w.url), lower(t.term))) WHERE k = 1"""
)
def site_lookup(spark, d):
    terms = spark.createDataFrame([("n_1",), ("nation_7.example",), ("nothing",)], "term string")
    return filters.ranked_lookup(t.website(spark, d), terms)


@query("SELECT f.id, f.title, f.feed_type, w.name AS site_name, w.url AS site_url FROM feed f JOIN website w ON w.id = f.website_id")
def feed_with_site(spark, d):
    return site_feed(spark, d).select("id", "title", "feed_type", "site_name", "site_url")


@query(f"SELECT id, url, feed_title, feed_type, site_name FROM ({ARTICLE_FULL})")
def article_full(spark, d):
    return full_articles(spark, d).select("id", "url", "feed_title", "feed_type", "site_name")


@query("SELECT l.id, l.started_at, l.success, f.title AS feed_title, w.name AS site_name FROM visit_log l JOIN feed f ON f.id = l.feed_id JOIN website w ON w.id = f.website_id")
def log_full(spark, d):
    return relations.with_feed(t.visit_log(spark, d), t.feed(spark, d), t.website(spark, d)).select("id", "started_at", "success", "feed_title", "site_name")


@query("SELECT website_id, id, CAST(row_number() OVER (PARTITION BY website_id ORDER BY active DESC, feed_type, title, id) AS INT) AS position FROM feed")
def site_feeds(spark, d):
    w = Window.partitionBy("website_id").orderBy(F.desc("active"), "feed_type", "title", "id")
    return t.feed(spark, d).select("website_id", "id", F.row_number().over(w).alias("position"))


@query("SELECT id, title, published_date FROM article ORDER BY published_date DESC NULLS LAST, retrieved_at DESC NULLS LAST, id LIMIT 10")
def recent_articles(spark, d):
    return t.article(spark, d).orderBy(*relations.article_order()).limit(10).select("id", "title", "published_date")


@query("SELECT id, feed_id, started_at, success FROM visit_log ORDER BY started_at DESC, id DESC LIMIT 10")
def recent_logs(spark, d):
    return t.visit_log(spark, d).orderBy(*relations.log_order()).limit(10).select("id", "feed_id", "started_at", "success")


@query("SELECT id, url FROM article ORDER BY published_date DESC NULLS LAST, retrieved_at DESC NULLS LAST, id LIMIT 25 OFFSET 50")
def page_articles(spark, d):
    return relations.page(t.article(spark, d), relations.article_order(), number=3, size=25).select("id", "url")


@query(
    """SELECT 'website' AS entity, count(*) AS kept FROM website WHERE id NOT IN (3, 7) UNION ALL SELECT 'feed', count(*) FROM feed WHERE website_id NOT IN (3, 7)
       UNION ALL SELECT 'article', count(*) FROM article WHERE feed_id NOT IN (SELECT id FROM feed WHERE website_id IN (3, 7))
       UNION ALL SELECT 'log', count(*) FROM visit_log WHERE feed_id NOT IN (SELECT id FROM feed WHERE website_id IN (3, 7))"""
)
def cascade_delete(spark, d):
    gone = spark.createDataFrame([(3,), (7,)], "id long")
    left = relations.cascade_delete(t.website(spark, d), t.feed(spark, d), t.article(spark, d), t.visit_log(spark, d), gone)
    counts = [df.agg(F.count("*").alias("kept")).select(F.lit(k).alias("entity"), "kept") for k, df in zip(("website", "feed", "article", "log"), left)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query(
    """SELECT r.request, a.id, a.url FROM full_article a JOIN (VALUES ('found', 'e'), ('not found', 'no such words')) AS r(request, q) ON contains(lower(a.title), r.q) OR contains(lower(a.summary), r.q) OR contains(lower(a.author), r.q)
       WHERE a.website_id = 3 AND a.published_date >= TIMESTAMP '1996-01-01 00:00:00' AND a.published_date <= TIMESTAMP '2000-06-01 00:00:00'
       AND a.feed_id = (SELECT feed_id FROM full_article WHERE website_id = 3 GROUP BY feed_id ORDER BY count(*) DESC, feed_id LIMIT 1)""",
    f"full_article AS ({ARTICLE_FULL})",
)
def request_articles(spark, d):
    """Lists of articles as requests' parameters ask for them: one for words that are there, one for words that are not."""
    full = full_articles(spark, d)
    feed = full.where("website_id = 3").groupBy("feed_id").count().orderBy(F.desc("count"), "feed_id").first()
    params = {"website": "3", "feed": str(feed.feed_id if feed else -1), "date_from": "1996-01-01", "date_to": "2000-06-01", "page": ""}
    lists = [filters.article_list(full, params | {"search": q}).select(F.lit(name).alias("request"), "id", "url") for name, q in (("found", "E"), ("not found", "No such words"))]
    return lists[0].unionAll(lists[1])


@query("SELECT f.id, f.title, w.name AS site_name FROM feed f JOIN website w ON w.id = f.website_id WHERE f.feed_type = 'RSS' AND NOT f.active AND (contains(lower(f.title), '1') OR contains(lower(f.feed_url), '1') OR contains(lower(w.name), '1'))")
def request_feeds(spark, d):
    return filters.feed_list(site_feed(spark, d), {"type": "RSS", "active": "false", "search": "1", "website": ""}).select("id", "title", "site_name")


@query("SELECT 'nation_7.example' AS term, count(*) = 1 AS single, CASE WHEN count(*) = 1 THEN min(name) ELSE '' END AS name FROM website WHERE contains(url, 'nation_7.example') UNION ALL SELECT 'nation_1', count(*) = 1, CASE WHEN count(*) = 1 THEN min(name) ELSE '' END FROM website WHERE contains(url, 'nation_1')")
def exactly_one(spark, d):
    """Whether a term names one site, and which."""
    return filters.only_matches(t.website(spark, d), "url", ["nation_7.example", "nation_1"], "name")


@query("SELECT 'RSS' AS kind, EXISTS (SELECT 1 FROM feed WHERE feed_type = 'RSS') AS found UNION ALL SELECT 'JSON', EXISTS (SELECT 1 FROM feed WHERE feed_type = 'JSON')")
def exists_kind(spark, d):
    return filters.having(t.feed(spark, d), "feed_type", ["RSS", "JSON"]).select(F.col("value").alias("kind"), "found")
