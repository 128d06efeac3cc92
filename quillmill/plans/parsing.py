"""Parsers over documents: made ones with a known content, and the stored pages.

Feeds, sitemaps and robots files are written from the tables by SQL
functions, so what the parsers must find is known from the tables themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.html import paragraph_runs, parse
from quillmill.functions.urls import resolve
from quillmill.operators import discover
from quillmill.sources import tables as t
from quillmill.sources.stage import Stage
from quillmill.sources.store import SeenKeys
from quillmill.streaming import jobs

from .registry import query
from .relational import site_feed


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rss_documents(spark: SparkSession, d: str) -> DataFrame:
    """One RSS or Atom document a feed, with its articles as entries in order of id."""
    a = t.article(spark, d)
    date = F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate>")), F.lit(""))
    where = F.when(F.col("id") % 4 == 0, F.concat(F.lit("<guid>"), escape(F.col("url")), F.lit("</guid>"))).otherwise(F.concat(F.lit("<link>"), escape(F.col("url")), F.lit("</link>")))
    where = F.when(F.col("author") == "", "").otherwise(where)
    item = F.concat(F.lit("<item>"), where, F.lit("<title>"), escape(F.col("title")), F.lit("</title><author>"), "author", F.lit("</author><description>"), escape(F.col("summary")), F.lit("</description>"), date, F.lit("<category>c"), (F.col("id") % 3).cast("string"), F.lit("</category></item>"))
    items = a.select("feed_id", F.struct("id", item.alias("x")).alias("i")).groupBy("feed_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "").alias("items"))
    head = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), escape(F.col("title")), F.lit("</title><description>d</description><link>"), "feed_url", F.lit("</link>"))
    end = F.when(F.col("id") % 9 == 0, "<item><title>cut off").otherwise("</channel></rss>")
    f = t.feed(spark, d)
    return f.join(items, f["id"] == items["feed_id"], "left").select(F.col("feed_url").alias("url"), F.lit(200).alias("status"), F.concat(head, F.coalesce("items", F.lit("")), end).alias("body"))


@query(
    """SELECT f.feed_url, a.url, trim(a.title, ' \n\t\r') AS title, trim(a.summary, ' \n\t\r') AS summary, a.author, a.published_date, concat('c', CAST(a.id % 3 AS VARCHAR)) AS tag
       FROM article a JOIN feed f ON f.id = a.feed_id WHERE a.author <> ''"""
)
def feed_parse(spark, d):
    rows = discover.feed_entries(rss_documents(spark, d), raw_data=False)
    return rows.select("feed_url", "url", "title", "summary", "author", "published_date", F.array_join("tags", ",").alias("tag"))


def probe_documents(spark: SparkSession, d: str) -> DataFrame:
    """What each feed's address answers: RSS, Atom behind a long comment and without entries, no XML at all, or a refusal."""
    title = F.concat(F.lit("<title>"), escape(F.col("title")), F.lit("</title>"))
    atom = F.concat(F.lit('<?xml version="1.0"?><!--'), F.repeat(F.lit("x "), F.lit(300)), F.lit('--><feed xmlns="http://www.w3.org/2005/Atom">'), title, F.lit("<subtitle>a</subtitle></feed>"))
    rss = F.concat(F.lit('<rss version="2.0"><channel>'), title, F.lit("<description>r</description></channel></rss>"))
    body = F.when(F.col("id") % 13 == 0, "not a feed").when(F.col("feed_type") == "ATOM", atom).otherwise(rss)
    return t.feed(spark, d).select(F.col("feed_url").alias("url"), F.when(F.col("id") % 11 == 0, 404).otherwise(200).alias("status"), body.alias("body"))


@query(
    """SELECT feed_url AS url, CASE WHEN ok THEN trim(title, ' ') END AS title, CASE WHEN ok THEN CASE feed_type WHEN 'ATOM' THEN 'ATOM' ELSE 'RSS' END END AS type, CASE WHEN ok THEN CASE feed_type WHEN 'ATOM' THEN 'a' ELSE 'r' END END AS description, ok AS valid
       FROM (SELECT *, id % 13 <> 0 AND id % 11 <> 0 AS ok FROM feed)"""
)
def feed_validate(spark, d):
    return discover.validated(probe_documents(spark, d))


def sitemap_documents(spark: SparkSession, d: str) -> DataFrame:
    """An index for each site; below it a sitemap for each of its feeds, with the articles' URLs; those of inactive feeds can't be reached."""
    ns = F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    urls = t.article(spark, d).groupBy("feed_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>")))), "").alias("urls"))
    f = t.feed(spark, d)
    leaves = f.join(urls, f["id"] == urls["feed_id"], "left").where("active").select(F.concat("feed_url", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), F.concat(ns, F.coalesce("urls", F.lit("")), F.lit("</urlset>")).alias("body"))
    children = site_feed(spark, d).groupBy("site_url").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "feed_url", F.lit("/sitemap.xml</loc></sitemap>")))), "").alias("c"))
    index = children.select(F.concat("site_url", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "c", F.lit("</sitemapindex>")).alias("body"))
    return leaves.unionAll(index)


def site_roots(spark: SparkSession, d: str) -> DataFrame:
    return t.website(spark, d).select(F.concat("url", F.lit("/sitemap.xml")).alias("url"))


@query("SELECT concat(w.url, '/sitemap.xml') AS root, a.url FROM article a JOIN feed f ON f.id = a.feed_id JOIN website w ON w.id = f.website_id WHERE f.active")
def sitemap_urls(spark, d):
    return discover.sitemap_pages(site_roots(spark, d), sitemap_documents(spark, d))


@query(
    """SELECT concat(w.url, '/sitemap.xml') AS root, concat(f.feed_url, '/sitemap.xml') AS url,
       CASE WHEN NOT f.active THEN 'Sitemap (unreachable)' WHEN count(a.id) > 0 THEN concat('Sitemap (', CAST(count(a.id) AS VARCHAR), ' URLs)') ELSE 'Sitemap' END AS title
       FROM feed f JOIN website w ON w.id = f.website_id LEFT JOIN article a ON a.feed_id = f.id GROUP BY w.url, f.feed_url, f.id, f.active
       UNION ALL SELECT concat(url, '/sitemap.xml'), concat(url, '/sitemap.xml'), 'Sitemap (unreachable)' FROM website w WHERE NOT EXISTS (SELECT 1 FROM feed f WHERE f.website_id = w.id)"""
)
def sitemap_expand(spark, d):
    return discover.expand_sitemaps(site_roots(spark, d), sitemap_documents(spark, d))


def robots_files(spark: SparkSession, d: str) -> DataFrame:
    lines = ["User-agent: *", "Sitemap: https://maps.example.org/a.xml", "SITEMAP:/local.xml", "Disallow: /x", "sitemap:"]
    return t.website(spark, d).select(F.col("url").alias("site"), F.lit("\n".join(lines)).alias("body"))


def answering_paths(spark: SparkSession, d: str) -> DataFrame:
    """Two of the common sitemap paths answer: one with an index of two sitemaps, one with a sitemap of one page."""
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = F.concat(F.lit(f"<sitemapindex {ns}><sitemap><loc>"), "url", F.lit("/m1.xml</loc></sitemap><sitemap><loc>"), "url", F.lit("/m2.xml</loc></sitemap></sitemapindex>"))
    pages = F.lit(f"<urlset {ns}><url><loc>https://p.example.org/</loc></url></urlset>")
    made = F.array(*(F.struct(F.lit(path).alias("p"), body.alias("body")) for path, body in (("/sitemap_index.xml", index), ("/sitemap.xml", pages), ("/m1.xml", pages))))
    return t.website(spark, d).select(F.explode(made).alias("x"), "url").select(F.concat("url", "x.p").alias("url"), F.lit(200).alias("status"), "x.body")


@query(
    """SELECT url AS site, 'https://maps.example.org/a.xml' AS url, 0 AS source, 1 AS pos FROM website UNION ALL SELECT url, concat(url, '/local.xml'), 0, 2 FROM website UNION ALL SELECT url, url, 0, 4 FROM website
       UNION ALL SELECT url, concat(url, '/sitemap.xml'), 1, 0 FROM website UNION ALL SELECT url, concat(url, '/sitemap_index.xml'), 1, 1 FROM website"""
)
def site_sitemaps(spark, d):
    return discover.site_sitemaps(t.website(spark, d), robots_files(spark, d), answering_paths(spark, d))


@query(
    """SELECT w.url AS site, CASE WHEN v.p LIKE 'https%' THEN v.p ELSE concat(w.url, v.p) END AS url, v.title FROM website w,
       (VALUES ('https://maps.example.org/a.xml', 'Sitemap (unreachable)'), ('/local.xml', 'Sitemap (unreachable)'), ('', 'Sitemap (unreachable)'), ('/sitemap.xml', 'Sitemap (1 URLs)'), ('/m1.xml', 'Sitemap (1 URLs)'), ('/m2.xml', 'Sitemap (unreachable)')) AS v(p, title)"""
)
def site_sitemap_feeds(spark, d):
    return discover.site_sitemap_feeds(t.website(spark, d), robots_files(spark, d), answering_paths(spark, d))


@query("SELECT url AS site, 1 AS pos, 'https://maps.example.org/a.xml' AS url FROM website UNION ALL SELECT url, 2, concat(url, '/local.xml') FROM website UNION ALL SELECT url, 4, url FROM website")
def robots_sitemaps(spark, d):
    return discover.robots_sitemaps(robots_files(spark, d))


def home_pages(spark: SparkSession, d: str) -> DataFrame:
    """A home page a site that links to all its feeds, RSS and Atom mixed."""
    mime = F.when(F.col("feed_type") == "ATOM", "application/atom+xml").otherwise("application/rss+xml")
    link = F.concat(F.lit('<link rel="alternate" type="'), mime, F.lit('" title="'), "title", F.lit('" href="'), "feed_url", F.lit('">'))
    return site_feed(spark, d).groupBy(F.col("site_url").alias("site")).agg(F.concat(F.lit("<html><head>"), F.array_join(F.array_sort(F.collect_list(link)), ""), F.lit("</head><body><p>x</body></html>")).alias("body"))


@query("SELECT w.url AS site, f.feed_url AS url, f.title, CASE f.feed_type WHEN 'ATOM' THEN 'application/atom+xml' ELSE 'application/rss+xml' END AS type FROM feed f JOIN website w ON w.id = f.website_id")
def discover_html(spark, d):
    return discover.html_links(home_pages(spark, d)).drop("pos")


def path_documents(spark: SparkSession, d: str) -> DataFrame:
    """Two common paths of each site answer with a feed, a third with something else."""
    body = F.lit('<rss version="2.0"><channel><title>Main</title></channel></rss>')
    rows = t.website(spark, d).select(F.explode(F.array(F.struct(F.lit("/feed").alias("p"), body.alias("body")), F.struct(F.lit("/rss.xml").alias("p"), body.alias("body")), F.struct(F.lit("/atom").alias("p"), F.lit("not a feed").alias("body")))).alias("x"), "url")
    return rows.select(F.concat("url", "x.p").alias("url"), F.lit(200).alias("status"), "x.body")


@query(
    """SELECT w.url AS site, f.feed_url AS url, 0 AS source, f.title FROM feed f JOIN website w ON w.id = f.website_id
       UNION ALL SELECT url, concat(url, p), 1, 'Main' FROM website, (VALUES ('/feed'), ('/rss.xml')) AS v(p)"""
)
def discover_all(spark, d):
    return discover.discover_all(home_pages(spark, d), t.website(spark, d), path_documents(spark, d)).select("site", "url", "source", "title")


@query("SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/next') AS absolute, concat('https://other.example.org/', CAST(page_id AS VARCHAR)) AS other FROM pages")
def url_resolve(spark, d):
    other = F.concat(F.lit("https://other.example.org/"), F.col("page_id").cast("string"))
    return t.table(spark, d, "pages").select("page_id", resolve("url", F.lit("/next")).alias("absolute"), resolve("url", other).alias("other"))


@query()
def page_extract(spark, d):
    """Article text of every stored page."""
    return discover.pages_with_text(t.table(spark, d, "pages")).select("page_id", "url", "page_content")


#: A page and its article for each way of finding one: HTML and text by article id, in which ``{k}`` is a paragraph of the article.
_KEPT = "{1}{2}{3}{4}{5}"
_LINES = [f"Line {k} of a page that has neither an article nor a paragraph." for k in range(10)]
MADE_PAGES = (
    ("<head><script>var a;</script><style>body</style></head><article>" + _KEPT + "</article>", "12345"),
    ("<nav>{9}</nav><header>{9}</header><div class='post-content'>{1}{2}<form>{9}</form><button>{9}</button>{3}{4}{5}</div><aside>{9}</aside><footer>{9}</footer>", "12345"),
    ("<div class='entry-content'>{1}<div class='ads'>{9}</div>{2}<div class='x sidebar'>{9}</div><div id='comments'>{9}</div>{3}{4}{5}</div>", "12345"),
    ("<article>{1}</article><div class='content'>" + _KEPT + "</div>", "12345"),
    ("<div role='main'><article>{1}<noscript>{9}</noscript>{2}{3}{4}{5}</article></div>", "12345"),
    ("<main><article><h2>short</h2>{1}{2}<p>too short to keep</p>{3}{4}{5}</article></main>", "12345"),
    ("<div itemprop='articleBody'>{1}{2}{3}{4}</div><article>" + _KEPT + "</article>", "12345"),
    ("{1}{2}{3}<p>short</p>{4}{5}", "123"),
    ("<p>short</p>{1}{2}<div>{3}</div><div class='menu'>{9}</div>", "123"),
    ("<div class='article-text'>" + _KEPT + "</div><div class='post-body'>{9}</div>", "12345"),
    ("{1}<p>short</p>{2}", ""),
    ("<![odd [markup]]><article>" + _KEPT + "</article>", ""),
    ("<div>" + "\n".join([*_LINES, "a short line"]) + "</div>", "\n".join(_LINES)),
)


def _paragraph(k: str) -> str:
    """SQL of the kth paragraph of article ``id``; both engines read it."""
    return f"concat('Paragraph {k} of the story about number ', CAST(id AS STRING), ' is <b>long</b> enough to stay.')"


def _plain(k: str) -> str:
    return _paragraph(k).replace(" is <b>long</b> enough", " islongenough")


def made_pages(spark: SparkSession, d: str) -> DataFrame:
    cases = []
    for html, _ in MADE_PAGES:
        parts = [f"concat('<p>', {_paragraph(x)}, '</p>')" if x.isdigit() else "'" + x.replace("'", '"') + "'" for x in re.split(r"[{}]", html) if x]
        cases.append("concat('<html>', " + ", ".join(parts) + ", '</html>')")
    pick = F.expr(f"CASE id % {len(MADE_PAGES)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END")
    return t.article(spark, d).select("id", "author").select("id", pick.alias("html"))


def _expected(kept: str) -> str:
    """SQL of what is kept of a made page: paragraphs by number, or a text as it is."""
    if not kept.isdigit():
        return f"'{kept}'" if kept else "NULL"
    return "concat_ws(chr(10) || chr(10), " + ", ".join(map(_plain, kept)) + ")"


_MADE = " ".join(f"WHEN {k} THEN {_expected(kept)}" for k, (_, kept) in enumerate(MADE_PAGES))


@query(f"SELECT id, CASE id % {len(MADE_PAGES)} {_MADE} END AS page_content FROM article")
def article_of_made_pages(spark, d):
    return discover.pages_with_text(made_pages(spark, d)).select("id", "page_content")


#: By kind of page: the paragraphs, also those that an article leaves out, that stand in runs.
_IN_RUNS = ("12345", "99129934599", "19299345", "112345", "192345", "345", "123412345", "123", "1239", "123459", "", "", "")
_RUNS = f"(CASE id % {len(MADE_PAGES)} " + " ".join(f"WHEN {k} THEN [{', '.join(runs)}]" for k, runs in enumerate(_IN_RUNS) if runs) + " ELSE [] END)"


@query(
    f"""SELECT id, CAST(pos - 1 AS INT) AS pos, concat('Paragraph ', CAST(k AS STRING), ' of the story about number ', CAST(id AS STRING)) AS head
       FROM (SELECT id, r[p] AS k, p AS pos FROM (SELECT id, {_RUNS} AS r FROM article), range(1, 20) AS x(p) WHERE p <= len(r))"""
)
def para_runs(spark, d):
    """Paragraphs of all made pages that stand in runs of long ones."""

    @F.pandas_udf("array<string>")
    def runs(pages):
        return pages.map(lambda h: paragraph_runs([text for _, text in parse(h or "").texts(frozenset(("p",)))]))

    return made_pages(spark, d).select("id", F.posexplode(runs("html")).alias("pos", "x")).select("id", "pos", F.regexp_extract("x", "^(.*) islong", 1).alias("head"))


def _drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream has written once its input is used up, from a table in the shared folder."""
    stage = Stage(stream.sparkSession, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{stage.path}/out")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{stage.path}/state").trigger(availableNow=True).start().awaitTermination()
    stage.drop("state")
    return stage.spark.read.parquet(f"{stage.path}/out")


def _drained_in_parts(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], name: str, mode: str, write: Callable[[Stage, DataFrame, int], None] | None = None, parts: int = 3) -> DataFrame:
    """What ``make`` of the log stream writes when the logs come in parts by time, the stream stopped and started from its checkpoint between them.

    ``write`` puts a batch in the stage's table ``out``; by default as it is, with its epoch.
    """
    stage = Stage(spark, name)
    events = t.table(spark, d, "events")
    cuts = events.agg(F.percentile_approx("ts", [(k + 1) / parts for k in range(parts - 1)])).first()[0] or []
    part = F.coalesce(F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("ts"))), F.lit(0)) if cuts else F.lit(0)

    def keep(batch: DataFrame, epoch: int) -> None:
        if write:
            write(stage, batch, epoch)
        else:
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{stage.path}/out")

    for k in range(parts):
        events.where(part == k).write.mode("append").parquet(f"{stage.path}/in")
        stream = make(as_logs(spark.readStream.schema(events.schema).parquet(f"{stage.path}/in")))
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{stage.path}/state").trigger(availableNow=True).start().awaitTermination()
    for done in ("in", "state"):
        stage.drop(done)
    return spark.read.parquet(f"{stage.path}/out")


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """Visit logs as a stream of files."""
    stored = t.table(spark, d, "events")
    return as_logs(spark.readStream.schema(stored.schema).option("pathGlobFilter", "events.parquet").parquet(d))


def as_logs(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("feed_id"), F.col("ts").alias("started_at"), (kind != "error").alias("success"), F.when(kind == "error", F.concat(F.lit("Network error: "), "props")).otherwise("").alias("error_message"), "event_type")


OFF = """off AS (
  SELECT feed_id, max(fails) >= 5 AS deactivated FROM (SELECT feed_id, run, count(*) FILTER (WHERE NOT success) AS fails FROM
    (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY feed_id ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM visit_log) GROUP BY feed_id, run) GROUP BY feed_id
)"""


@query("SELECT s.feed_id, s.last_checked, s.last_success, s.error_count, s.last_error, o.deactivated FROM feed_status s JOIN off o ON o.feed_id = s.feed_id", OFF)
def stream_health(spark, d):
    """The last state of each feed that the stateful stream reports, over several triggers and restarts."""
    out = _drained_in_parts(spark, d, jobs.health_stream, "health", "update")
    own = ["last_checked", "last_success", "error_count", "last_error", "deactivated"]
    last = out.groupBy("feed_id").agg(F.max_by(F.struct(*own), "_epoch").alias("s")).select("feed_id", "s.*")
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in own[:2]})


@query(
    """SELECT feed_id, started_at AS last_checked, started_at + INTERVAL '2' DAY AS quiet_at FROM (SELECT DISTINCT feed_id, started_at, lead(started_at) OVER (PARTITION BY feed_id ORDER BY started_at) AS following FROM visit_log)
       WHERE (following IS NULL OR following >= started_at + INTERVAL '2' DAY) AND started_at + INTERVAL '2' DAY <= (SELECT date_trunc('milliseconds', max(started_at)) FROM visit_log) - INTERVAL '1' HOUR"""
)
def stream_quiet(spark, d):
    """Silences of two days that the stream tells, over several triggers and restarts."""
    out = _drained_in_parts(spark, d, lambda logs: jobs.quiet_feeds(logs, "2 days"), "quiet", "append")
    return out.select("feed_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_checked", "quiet_at")))


@query("SELECT DISTINCT concat(CAST(user_id AS VARCHAR), ':', event_type) AS url FROM events")
def stream_dedup(spark, d):
    """Distinct keys that the deduplicating stream lets through."""
    rows = log_stream(spark, d).select(F.concat_ws(":", "feed_id", "event_type").alias("url"), F.col("started_at").cast("timestamp").alias("at"))
    return _drained(jobs.dedup_stream(rows, "at", "url", "60 days"), "dedup", "append").select("url")


@query("SELECT id, url FROM (SELECT event_id AS id, concat(CAST(user_id AS VARCHAR), ':', event_type) AS url, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def stream_first_seen(spark, d):
    """The first row of each key over all time, however long ago it was, over several triggers and restarts."""

    def write(stage: Stage, batch: DataFrame, epoch: int) -> None:
        rows = batch.select("id", "started_at", F.concat_ws(":", "feed_id", "event_type").alias("url"))
        first = SeenKeys(stage.spark, f"{stage.path}/seen").first_seen(rows, "url", ["started_at", "id"], epoch)
        first.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(f"{stage.path}/out")

    return _drained_in_parts(spark, d, lambda logs: logs, "seen", "append", write).select("id", "url")


@query("SELECT date_trunc('hour', started_at) AS hour, count(*) AS visits, count(*) FILTER (WHERE NOT success) AS failures FROM visit_log GROUP BY 1")
def stream_windows(spark, d):
    """Visits and failures by hour as the windowed stream last reports them."""
    out = _drained(jobs.windowed_counts(log_stream(spark, d), "3650 days").select(F.col("window.start").alias("hour"), "visits", "failures"), "windows", "update")
    last = out.groupBy("hour").agg(F.max_by(F.struct("visits", "failures"), "_epoch").alias("s"))
    return last.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "s.visits", "s.failures")
