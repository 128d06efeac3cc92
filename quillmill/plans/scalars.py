"""Scalar expressions over the domain's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as x
from quillmill.functions import urls as u
from quillmill.operators import relations
from quillmill.sources import tables as t

from .registry import query
from .relational import ARTICLE_FULL, feed_state, full_articles, site_feed

_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


@query("SELECT id, CASE WHEN content = '' THEN '' ELSE sha256(concat(title, content, summary)) END AS content_hash FROM article")
def content_hash(spark, d):
    return t.article(spark, d).select("id", x.stored_hash(F.col("title"), F.col("content"), F.col("summary")).alias("content_hash"))


@query("SELECT id, CASE WHEN title = '' THEN feed_url ELSE title END AS name, CASE WHEN title = '' THEN left(feed_url, 50) ELSE title END AS short_name FROM feed")
def display_title(spark, d):
    title, url = F.col("title"), F.col("feed_url")
    return t.feed(spark, d).select("id", x.display_title(title, url).alias("name"), x.display_title(title, url, 50).alias("short_name"))


@query("SELECT id, coalesce(published_date, retrieved_at) AS effective_date FROM article")
def effective_date(spark, d):
    return t.article(spark, d).select("id", F.coalesce("published_date", "retrieved_at").alias("effective_date"))


@query("SELECT f.id, coalesce(strftime(s.last_checked, '%Y-%m-%d %H:%M'), 'Never') AS last_checked FROM feed f LEFT JOIN feed_status s ON s.feed_id = f.id")
def fmt_dates(spark, d):
    return feed_state(spark, d).select("id", x.minute(F.col("last_checked")).alias("last_checked"))


_PATHS = "slug AS (SELECT page_id AS id, replace(regexp_replace(url, '[?#].*', ''), '_', '-') AS url FROM pages UNION ALL SELECT id + 1000000, url FROM article)"


@query(f"SELECT id, CASE WHEN t = '' THEN url ELSE t END AS title FROM (SELECT id, url, {_TITLE.format('s')} AS t FROM (SELECT id, url, coalesce(replace(CASE WHEN url[-1] = '/' THEN string_split(url, '/')[-2] ELSE string_split(url, '/')[-1] END, '-', ' '), '') AS s FROM slug))", _PATHS)
def slug_title(spark, d):
    pages = t.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.replace(F.regexp_replace("url", "[?#].*", ""), F.lit("_"), F.lit("-")).alias("url"))
    rows = pages.unionAll(t.article(spark, d).select(F.col("id") + 1000000, "url"))
    return rows.select("id", x.slug_title(F.col("url")).alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 497) || '...' ELSE text END AS stored, left(text, 500) AS repaired, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS listed, left(text, 80) AS report, CASE WHEN length(text) > 100 THEN left(text, 99) || '…' ELSE text END AS page FROM documents")
def truncations(spark, d):
    c = F.col("text")
    return t.table(spark, d, "documents").select("doc_id", x.clip(c, 500).alias("stored"), F.left(c, F.lit(500)).alias("repaired"), x.clip(c, 60).alias("listed"), F.left(c, F.lit(80)).alias("report"), x.clip(c, 100, "…").alias("page"))


@query("SELECT id, CASE WHEN completed_at IS NULL THEN '-' ELSE printf('%.1fs', (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0) END AS duration FROM visit_log")
def visit_duration(spark, d):
    return t.visit_log(spark, d).select("id", x.duration_text(F.col("started_at"), F.col("completed_at")).alias("duration"))


@query("SELECT f.id, CASE WHEN coalesce(s.error_count, 0) > 0 THEN concat(CAST(s.error_count AS VARCHAR), ' errors') WHEN s.last_success IS NOT NULL THEN 'OK' ELSE '-' END AS status FROM feed f LEFT JOIN feed_status s ON s.feed_id = f.id")
def error_status(spark, d):
    return feed_state(spark, d).select("id", x.status_text(F.col("error_count"), F.col("last_success")).alias("status"))


@query("SELECT id, CASE feed_type WHEN 'RSS' THEN 'RSS Feed' WHEN 'ATOM' THEN 'Atom Feed' ELSE 'Sitemap' END AS label FROM feed")
def feed_label(spark, d):
    return t.feed(spark, d).select("id", x.feed_label(F.col("feed_type")).alias("label"))


_MIME = "CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'application/atom+xml' WHEN 1 THEN 'application/rss+xml' WHEN 2 THEN 'TEXT/XML' ELSE '' END"


@query(f"SELECT page_id, CASE WHEN contains(lower(u), 'atom') OR contains(lower(m), 'atom') THEN 'ATOM' WHEN contains(lower(u), 'sitemap') THEN 'SITEMAP' ELSE 'RSS' END AS feed_type FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat(url, '/Sitemap.xml') ELSE url END AS u, {_MIME} AS m FROM pages)")
def feed_type_infer(spark, d):
    mime = F.get(F.array(*map(F.lit, ("application/atom+xml", "application/rss+xml", "TEXT/XML", ""))), (F.col("page_id") % 4).cast("int"))
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/Sitemap.xml"))).otherwise(F.col("url"))
    return t.table(spark, d, "pages").select("page_id", x.feed_type_from(url, mime).alias("feed_type"))


@query(
    """SELECT page_id, CASE WHEN site LIKE 'http://%' OR site LIKE 'https://%' THEN site ELSE concat('https://', site) END AS site,
       concat(CASE WHEN site LIKE 'http://%' THEN 'http://' ELSE 'https://' END, 'feeds.example.com/', CAST(page_id AS VARCHAR)) AS feed,
       CASE WHEN upper(kind) IN ('RSS', 'ATOM', 'SITEMAP') THEN upper(kind) ELSE 'RSS' END AS kind
       FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END AS site, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'atom' WHEN 1 THEN 'Sitemap' WHEN 2 THEN 'json' ELSE 'RSS' END AS kind FROM pages)"""
)
def url_normalize(spark, d):
    url = F.col("url")
    site = u.with_scheme(F.when(F.col("page_id") % 3 == 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(url))
    kind = F.get(F.array(*map(F.lit, ("atom", "Sitemap", "json", "RSS"))), (F.col("page_id") % 4).cast("int"))
    rows = t.table(spark, d, "pages").select("page_id", site.alias("site"), x.known_type(kind).alias("kind"))
    return rows.select("page_id", "site", u.with_scheme(F.concat(F.lit("feeds.example.com/"), F.col("page_id").cast("string")), u.scheme_of(F.col("site"))).alias("feed"), "kind")


@query("SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, d):
    return t.table(spark, d, "pages").groupBy(u.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT 'website' AS entity, id, concat(name, ' (', url, ')') AS label FROM website
       UNION ALL SELECT 'feed', f.id, concat(w.name, ' - ', f.feed_type, ': ', CASE WHEN f.title = '' THEN f.feed_url ELSE f.title END) FROM feed f JOIN website w ON w.id = f.website_id
       UNION ALL SELECT 'article', id, concat(title, ' (', site_name, ')') FROM ({ARTICLE_FULL})
       UNION ALL SELECT 'log', l.id, concat(CASE WHEN f.title = '' THEN f.feed_url ELSE f.title END, ' - ', strftime(l.started_at, '%Y-%m-%d %H:%M:%S'), ' - ', CASE WHEN l.success THEN 'Success' ELSE 'Failed' END) FROM visit_log l JOIN feed f ON f.id = l.feed_id"""
)
def display_strings(spark, d):
    feeds = site_feed(spark, d)
    name = x.display_title(F.col("title"), F.col("feed_url"))
    logs = relations.with_feed(t.visit_log(spark, d), t.feed(spark, d), t.website(spark, d))
    log_name = x.display_title(F.col("feed_title"), F.col("feed_url"))
    parts = [
        t.website(spark, d).select(F.lit("website").alias("entity"), "id", F.concat("name", F.lit(" ("), "url", F.lit(")")).alias("label")),
        feeds.select(F.lit("feed"), "id", F.concat("site_name", F.lit(" - "), "feed_type", F.lit(": "), name)),
        full_articles(spark, d).select(F.lit("article"), "id", F.concat("title", F.lit(" ("), "site_name", F.lit(")"))),
        logs.select(F.lit("log"), "id", F.concat(log_name, F.lit(" - "), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" - "), F.when(F.col("success"), "Success").otherwise("Failed"))),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return t.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT id, CASE WHEN id % 3 = 0 AND content <> '' THEN content WHEN id % 3 = 1 AND title <> '' THEN title ELSE summary END AS best FROM article")
def content_priority(spark, d):
    page = F.when(F.col("id") % 3 == 0, F.col("content"))
    values = F.when(F.col("id") % 3 == 1, F.array(F.lit(""), F.col("title"))).otherwise(F.array().cast("array<string>"))
    return t.article(spark, d).select("id", F.coalesce(x.first_filled(page, F.get(F.filter(values, lambda v: v != ""), F.lit(0))), F.col("summary")).alias("best"))


@query(f"SELECT page_id, contains(lower(m), 'text/html') OR contains(lower(m), 'application/xhtml') AS usable FROM (SELECT page_id, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN 'application/pdf' ELSE '' END AS m FROM pages)")
def content_type_gate(spark, d):
    kind = F.get(F.array(*map(F.lit, ("Text/HTML; charset=utf-8", "application/xhtml+xml", "application/pdf", ""))), (F.col("page_id") % 4).cast("int"))
    return t.table(spark, d, "pages").select("page_id", x.html_like(kind).alias("usable"))
