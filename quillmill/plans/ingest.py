"""Batches against stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import stored_hash
from quillmill.functions.urls import FEED_PATHS
from quillmill.operators import discover, health, schedule, stats
from quillmill.operators import ingest as op
from quillmill.operators.library import Library
from quillmill.sources import tables as t
from quillmill.sources.stage import Stage
from quillmill.sources.store import BucketTable

from .parsing import probe_documents
from .registry import query
from .relational import feed_state, full_articles, site_feed

# A batch of entries: all articles twice in a row, the second time with a
# changed title where there is no author.  Stored are those with a date.
BATCH = """
stored AS (SELECT id, feed_id, url, title, content, summary, author, published_date, '{}' AS raw_data, CASE WHEN content = '' THEN '' ELSE sha256(concat(title, content, summary)) END AS content_hash FROM article WHERE published_date IS NOT NULL),
batch AS (
  SELECT 2 * id AS pos, feed_id, url, title, content, summary, author, published_date, concat('{"pos":', CAST(2 * id AS STRING), '}') AS raw_data FROM article
  UNION ALL SELECT 2 * id + 1, feed_id + 1, url, CASE WHEN author = '' THEN concat(title, ' *') ELSE title END, content, summary, 'Second', NULL, concat('{"pos":', CAST(2 * id + 1 AS STRING), '}') FROM article
), hashed AS (SELECT *, sha256(concat(title, content, summary)) AS hash FROM batch),
marked AS (
  SELECT b.*, s.url IS NOT NULL AS known, s.content_hash, row_number() OVER w AS k,
         last_value(CASE WHEN b.content <> '' THEN b.hash END IGNORE NULLS) OVER (PARTITION BY b.url ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept
  FROM hashed b LEFT JOIN stored s ON s.url = b.url WINDOW w AS (PARTITION BY b.url ORDER BY b.pos)
), classified AS (
  SELECT *, CASE WHEN k = 1 AND NOT known THEN 'new' WHEN hash <> coalesce(kept, content_hash, '') THEN 'updated' ELSE 'unchanged' END AS status FROM marked
)"""


def stored(spark: SparkSession, d: str) -> DataFrame:
    return t.article(spark, d).where(F.col("published_date").isNotNull()).withColumn("content_hash", stored_hash(F.col("title"), F.col("content"), F.col("summary"))).withColumn("raw_data", F.lit("{}"))


def batch(spark: SparkSession, d: str) -> DataFrame:
    a = t.article(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    second, pos = F.col("k") == 1, F.col("id") * 2 + F.col("k")
    title = F.when(second & (F.col("author") == ""), F.concat("title", F.lit(" *"))).otherwise(F.col("title"))
    raw = F.concat(F.lit('{"pos":'), pos.cast("string"), F.lit("}"))
    author, date = F.when(second, "Second").otherwise(F.col("author")), F.when(~second, F.col("published_date"))
    return a.select(pos.alias("pos"), (F.col("feed_id") + F.col("k")).alias("feed_id"), "url", title.alias("title"), "content", "summary", author.alias("author"), date.alias("published_date"), raw.alias("raw_data"))


@query("SELECT pos, url, hash, status FROM classified", BATCH)
def upsert_classify(spark, d):
    return op.classify(batch(spark, d), stored(spark, d)).select("pos", "url", "hash", "status")


@query("SELECT count(*) FILTER (WHERE status = 'new') AS new_articles, count(*) FILTER (WHERE status = 'updated') AS updated_articles, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM classified", BATCH)
def upsert_counts(spark, d):
    return op.run_counts(op.classify(batch(spark, d), stored(spark, d)))


_CHANGED = ", ".join(f"CASE WHEN c.url IS NOT NULL THEN c.{x} ELSE s.{x} END AS {x}" for x in op.FIELDS)


_SNAPSHOT = f"""SELECT coalesce(s.url, b.url) AS url, coalesce(s.feed_id, b.feed_id) AS feed_id, {_CHANGED}, coalesce(h.hash, s.content_hash, '') AS content_hash
       FROM stored s FULL JOIN (SELECT url, feed_id FROM (SELECT url, feed_id, row_number() OVER (PARTITION BY url ORDER BY pos) AS k FROM batch) WHERE k = 1) b ON b.url = s.url
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos DESC) AS nth FROM classified WHERE status <> 'unchanged') WHERE nth = 1) c ON c.url = coalesce(s.url, b.url)
       LEFT JOIN (SELECT url, hash FROM (SELECT url, hash, row_number() OVER (PARTITION BY url ORDER BY pos DESC) AS k FROM hashed WHERE content <> '') WHERE k = 1) h ON h.url = coalesce(s.url, b.url)"""


@query(_SNAPSHOT, BATCH)
def upsert_snapshot(spark, d):
    """All of the article table after a batch: what an entry writes over, its owner and its hash."""
    return op.upsert(stored(spark, d).select("url", "feed_id", *op.FIELDS, "content_hash"), batch(spark, d))


@query(_SNAPSHOT, BATCH)
def stored_upsert(spark, d):
    """The same batch against a table stored in buckets, applied, and then applied again as after a lost acknowledgement."""
    rows = stored(spark, d).select("url", "feed_id", *op.FIELDS, "content_hash")
    table = BucketTable(spark, Stage(spark, "stored").path, "url", rows.schema, 16)
    table.apply(0, rows, lambda old, new, bucket: new.sortWithinPartitions(bucket), in_buckets=True)
    for _ in range(2):
        table.apply(1, batch(spark, d), op.upsert, in_buckets=True)
    return table.read()


@query(
    """SELECT f.feed_url, w.url AS site, CASE WHEN f.id % 3 = 0 THEN f.feed_type WHEN f.feed_type = 'ATOM' THEN 'ATOM' ELSE 'RSS' END AS feed_type,
       coalesce(CASE WHEN f.id % 3 = 0 AND f.title <> '' THEN f.title END, CASE WHEN f.id % 2 = 0 THEN concat('N', CAST(f.id AS VARCHAR)) END, 'Late') AS title,
       CASE WHEN f.id % 3 <> 0 AND f.id % 2 = 0 THEN concat(w.name, ' - N', CAST(f.id AS VARCHAR)) ELSE '' END AS description FROM feed f JOIN website w ON w.id = f.website_id"""
)
def stored_feed_lists(spark, d):
    """Lists of all sites' feeds, each feed twice, put into stored tables that have a third of them; applied, and applied again."""
    feeds, stage = site_feed(spark, d), Stage(spark, "library")
    library = Library(spark, stage.path)
    as_of, none = stats.latest(t.visit_log(spark, d), "started_at"), F.lit(None).cast("timestamp_ntz")
    sites = t.website(spark, d).withColumns({"created_at": as_of, "updated_at": as_of})
    library.sites.apply(0, sites, lambda old, new: new.select(*old.columns))
    have = feeds.where("id % 3 = 0").withColumns({"description": F.lit(""), "last_checked": none, "last_success": none, "error_count": F.lit(0), "last_error": F.lit(""), "created_at": as_of, "updated_at": as_of})
    library.feeds.apply(0, have, lambda old, new: new.select(*old.columns))
    named = F.when(F.col("id") % 2 == 0, F.concat(F.lit("N"), F.col("id").cast("string")))
    entry = lambda pos, name: F.struct(pos.alias("pos"), name.alias("name"))
    twice = F.array(entry(F.col("id"), named), entry(F.col("id") + 1_000_000_000_000, F.lit("Late")))
    kind = F.when(F.col("feed_type") == "ATOM", "atom").otherwise("other")
    rows = feeds.select("site_url", "site_name", F.col("feed_url").alias("url"), kind.alias("type"), F.explode(twice).alias("e")).select("e.pos", "site_url", "site_name", "url", "e.name", "type")
    for _ in range(2):
        library.add_feeds(1, rows, as_of)
    own = library.sites.read().select(F.col("id").alias("website_id"), F.col("url").alias("site"))
    return library.feeds.read().join(own, "website_id").select("feed_url", "site", "feed_type", "title", "description")


@query("SELECT id, feed_id, started_at FROM visit_log WHERE NOT started_at < (SELECT max(started_at) FROM visit_log) - INTERVAL '10' DAY")
def stored_retention(spark, d):
    """Logs left in a stored table, in which only the buckets that lose rows are written."""
    logs = t.visit_log(spark, d).select("id", "feed_id", "started_at")
    table = BucketTable(spark, Stage(spark, "logs").path, "id", logs.schema, 16)
    table.apply(0, logs, lambda old, new: new)
    table.delete(1, F.col("started_at") < F.lit(logs.agg(F.max("started_at")).first()[0]) - F.make_dt_interval(days=F.lit(10)))
    return table.read()


@query(
    """SELECT feed_url, title FROM (SELECT feed_url, title, row_number() OVER (PARTITION BY feed_url ORDER BY pos) AS k FROM
       (SELECT id AS pos, concat('https://feeds.example.com/', CAST(id * 2 // 3 AS VARCHAR)) AS feed_url, title FROM feed) b WHERE NOT EXISTS (SELECT 1 FROM feed f WHERE f.feed_url = b.feed_url AND f.active)) WHERE k = 1"""
)
def get_or_create(spark, d):
    feeds = t.feed(spark, d)
    listed = feeds.select(F.col("id").alias("pos"), F.concat(F.lit("https://feeds.example.com/"), F.floor(F.col("id") * 2 / 3).cast("string")).alias("feed_url"), "title")
    return op.get_or_create(listed, feeds.where("active"), "feed_url", ["pos"]).select("feed_url", "title")


_SITEMAP = """
known AS (SELECT * FROM article WHERE author <> ''),
listed AS (SELECT a.id AS pos, a.feed_id, f.feed_url, CASE WHEN a.published_date IS NULL THEN concat(a.url, repeat('y', 2100)) ELSE a.url END AS url FROM article a JOIN feed f ON f.id = a.feed_id WHERE f.feed_type = 'SITEMAP')"""


@query(
    """SELECT feed_id, url, concat('Story ', regexp_extract(url, 'story-([0-9]+)', 1)) AS title, concat('Article from sitemap: ', feed_url) AS summary, (SELECT max(retrieved_at) FROM article) AS published_date
       FROM listed l WHERE length(url) <= 2048 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.url = l.url)""",
    _SITEMAP,
)
def sitemap_new(spark, d):
    a = t.article(spark, d)
    long = F.when(F.col("published_date").isNull(), F.concat("url", F.repeat(F.lit("y"), F.lit(2100)))).otherwise(F.col("url"))
    feeds = t.feed(spark, d).where("feed_type = 'SITEMAP'").select(F.col("id").alias("feed_id"), "feed_url")
    listed = a.join(feeds, "feed_id").select(F.col("id").alias("pos"), "feed_id", "feed_url", long.alias("url"))
    return op.sitemap_entries(listed, a.where(F.col("author") != ""), stats.latest(a, "retrieved_at"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved text for the articles that have an author."""
    return t.article(spark, d).where(F.col("author") != "").select("url", F.concat(F.lit("Text of "), "url").alias("page_content"))


@query("SELECT a.id, concat('Text of ', a.url) AS page_content FROM article a JOIN feed f ON f.id = a.feed_id WHERE a.content = '' AND a.author <> '' AND f.feed_type = 'SITEMAP'")
def sitemap_fill(spark, d):
    return op.fill_content(full_articles(spark, d).where("feed_type = 'SITEMAP'"), page_texts(spark, d)).select("id", "page_content")


@query("SELECT DISTINCT a.id AS article_id, b.feed_id FROM batch b JOIN article a ON a.url = b.url WHERE b.feed_id <> a.feed_id AND a.author <> ''", BATCH)
def crosspost(spark, d):
    a = t.article(spark, d)
    linked = a.where(F.col("author") == "").select(F.col("id").alias("article_id"), (F.col("feed_id") + 1).alias("feed_id"))
    return op.cross_posts(batch(spark, d), a, linked)


@query("SELECT id, concat('Text of ', url) AS page_content FROM article WHERE content = '' AND author <> ''")
def content_fill(spark, d):
    return op.fill_content(t.article(spark, d), page_texts(spark, d)).select("id", "page_content")


@query(
    """SELECT id, CASE WHEN id % 3 = 0 OR contains(title, '/') THEN concat('Story ', CAST(id AS VARCHAR)) ELSE title END AS new_title, concat('Text of ', url) AS page_content
       FROM article WHERE content = '' AND author <> ''"""
)
def missing_repair(spark, d):
    a = t.article(spark, d).withColumn("title", F.when(F.col("id") % 3 == 0, F.col("url")).otherwise(F.col("title")))
    return op.repair(a, page_texts(spark, d)).select("id", "new_title", "page_content")


@query(
    """SELECT action, count(*) AS n, count(*) FILTER (WHERE description <> '') AS described FROM (
         SELECT CASE WHEN NOT f.active THEN 'created' WHEN f.id % 2 = 0 AND f.title = '' THEN 'updated' ELSE 'skipped' END AS action, CASE WHEN f.id % 2 = 0 THEN concat(w.name, ' - ', 'Feed ', CAST(f.id AS VARCHAR)) ELSE '' END AS description
         FROM feed f JOIN website w ON w.id = f.website_id) GROUP BY action"""
)
def multi_feed_summary(spark, d):
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Feed "), F.col("id").cast("string"))).otherwise("")
    listed = site_feed(spark, d).select("feed_url", name.alias("name"), "site_name")
    done = op.multi_feed(listed, t.feed(spark, d).where("active"))
    return done.groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.col("description") != "").alias("described"))


@query("SELECT id, CASE WHEN id IN (1, 2, 3, 5, 8) THEN false ELSE active END AS active FROM feed")
def bulk_set_active(spark, d):
    return health.set_active(t.feed(spark, d), [1, 2, 3, 5, 8], False).select("id", "active")


@query("SELECT f.id, CASE WHEN f.id IN (1, 2, 3, 5, 8) THEN 0 ELSE coalesce(s.error_count, 0) END AS error_count, f.active FROM feed f LEFT JOIN feed_status s ON s.feed_id = f.id")
def reset_errors(spark, d):
    return health.reset_errors(feed_state(spark, d), [1, 2, 3, 5, 8]).select("id", F.col("error_count").cast("long").alias("error_count"), "active")


@query("SELECT id, started_at FROM visit_log WHERE started_at >= (SELECT max(started_at) FROM visit_log) - INTERVAL '10' DAY")
def retention_keep(spark, d):
    logs = t.visit_log(spark, d)
    return op.split_logs(logs, stats.latest(logs, "started_at"), 10)[0].select("id", "started_at")


@query("SELECT count(*) AS deleted FROM visit_log WHERE started_at < (SELECT max(started_at) FROM visit_log) - INTERVAL '10' DAY")
def retention_count(spark, d):
    logs = t.visit_log(spark, d)
    return op.split_logs(logs, stats.latest(logs, "started_at"), 10)[1].agg(F.count("*").alias("deleted"))


@query(f"SELECT url AS site, CAST(k - 1 AS INT) AS pos, concat(url, (list_value({', '.join(repr(p) for p in FEED_PATHS)}))[k]) AS url FROM website, range(1, {len(FEED_PATHS) + 1}) r(k)")
def candidate_paths(spark, d):
    return discover.candidates(t.website(spark, d))


@query(
    """SELECT feed_id, CASE WHEN feed_id % 5 <> 4 THEN now END AS completed_at, now AS started_at, feed_id % 5 < 3 AS success, CAST(CASE WHEN feed_id % 5 < 3 THEN feed_id % 7 ELSE 0 END AS INT) AS new_articles,
       CAST(CASE WHEN feed_id % 5 < 3 THEN feed_id % 3 ELSE 0 END AS INT) AS updated_articles, CASE WHEN feed_id % 5 = 3 THEN concat('Timeout ', CAST(feed_id AS VARCHAR)) ELSE '' END AS error_message
       FROM (SELECT id AS feed_id, (SELECT max(started_at) FROM visit_log) AS now FROM feed WHERE active)"""
)
def log_life_cycle(spark, d):
    """Logs opened for the active feeds; three of five runs succeed, one fails, one never ends."""
    now = stats.latest(t.visit_log(spark, d), "started_at")
    feeds = t.feed(spark, d).where("active").select(F.col("id").alias("feed_id"))
    kind = F.col("feed_id") % 5
    results = feeds.where(kind < 4).select("feed_id", F.when(kind == 3, F.concat(F.lit("Timeout "), F.col("feed_id").cast("string"))).alias("error"), (F.col("feed_id") % 7).alias("new_articles"), (F.col("feed_id") % 3).alias("updated_articles"))
    return op.close_logs(op.open_logs(feeds, now), results, now)


@query(
    """SELECT f.id, CASE WHEN f.id % 13 <> 0 AND f.id % 11 <> 0 THEN trim(f.title, ' ') ELSE f.title END AS title, CASE WHEN f.id % 13 <> 0 AND f.id % 11 <> 0 THEN CASE f.feed_type WHEN 'ATOM' THEN 'a' ELSE 'r' END ELSE 'before' END AS description FROM feed f"""
)
def enrich_feeds(spark, d):
    feeds = t.feed(spark, d).withColumn("description", F.lit("before"))
    found = discover.validated(probe_documents(spark, d)).withColumnRenamed("url", "feed_url")
    return op.enrich(feeds, found).select("id", "title", "description")


def site_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth site edited, and as many created."""
    edited = t.website(spark, d).where("id % 4 = 0").select("id", F.lit("New name").alias("name"), (F.col("id") % 8 == 0).alias("active"))
    return edited.unionAll(edited.select(F.col("id") + 1000, "name", "active"))


@query(
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'New name' ELSE name END AS name, url, CASE WHEN id % 4 = 0 THEN id % 8 = 0 ELSE active END AS active FROM website
       UNION ALL SELECT id + 1000, 'New name', NULL, id % 8 = 0 FROM website WHERE id % 4 = 0"""
)
def put_websites(spark, d):
    return op.put_rows(t.website(spark, d).select("id", "name", "url", "active"), site_forms(spark, d))


@query("SELECT id + 1000 AS id, 'New name' AS name, id % 8 = 0 AS active FROM website WHERE id % 4 = 0")
def sites_to_discover(spark, d):
    """Created sites, which discovery is to visit."""
    return schedule.created(t.website(spark, d), site_forms(spark, d))


def site_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every site asked for, and as many that don't exist."""
    ids = t.website(spark, d).select(F.col("id").alias("website_id"))
    return ids.unionAll(ids.select(F.col("website_id") + 1000))


#: Feeds of which every fifth site has no active one.
_QUIET = "asked AS (SELECT id AS website_id FROM website UNION ALL SELECT id + 1000 FROM website), quiet AS (SELECT id, website_id, active AND website_id % 5 <> 0 AS active FROM feed)"


def quiet_feeds(spark: SparkSession, d: str) -> DataFrame:
    return t.feed(spark, d).withColumn("active", F.col("active") & (F.col("website_id") % 5 != 0))


@query("SELECT website_id, id AS feed_id FROM quiet WHERE active AND website_id IN (SELECT website_id FROM asked) AND website_id IN (SELECT id FROM website)", _QUIET)
def site_work(spark, d):
    return schedule.site_work(site_requests(spark, d), t.website(spark, d), quiet_feeds(spark, d))


@query(
    """SELECT a.website_id, w.name, CASE WHEN w.id IS NULL THEN 'not_found' WHEN count(q.id) = 0 THEN 'no_active_feeds' ELSE 'queued' END AS outcome, count(q.id) AS feeds
       FROM asked a LEFT JOIN website w ON w.id = a.website_id LEFT JOIN quiet q ON q.website_id = w.id AND q.active GROUP BY a.website_id, w.id, w.name""",
    _QUIET,
)
def site_outcomes(spark, d):
    return schedule.site_outcomes(site_requests(spark, d), t.website(spark, d), quiet_feeds(spark, d))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'Edited' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 'By hand' ELSE '' END AS description, CASE WHEN id % 3 = 0 THEN NOT active ELSE active END AS active FROM feed")
def edit_feeds(spark, d):
    feeds = t.feed(spark, d).select("id", "title", F.lit("").alias("description"), "active")
    return op.put_rows(feeds, feeds.where("id % 3 = 0").select("id", F.lit("Edited").alias("title"), F.lit("By hand").alias("description"), (~F.col("active")).alias("active")))


@query(
    """SELECT url, attempts, CASE WHEN id % 6 = 5 THEN 'timeout' WHEN id % 6 = 4 THEN 'http_error' ELSE 'ok' END AS outcome
       FROM (SELECT id, url, CAST(CASE id % 6 WHEN 5 THEN 3 WHEN 4 THEN 1 WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS INT) AS attempts FROM article)"""
)
def retry_policy(spark, d):
    """Five tries stand ready for each article; what the policy makes of them."""
    a = t.article(spark, d).select("id", "url")
    tries = a.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(5))))
    kind, k = F.col("id") % 6, F.col("attempt")
    outcome = F.when(kind == 5, "timeout").when(kind == 4, "http_error").when((kind == 3) & (k < 3), "timeout").when((kind == 2) & (k < 2), "timeout").otherwise("ok")
    return op.retried(tries.select("url", "attempt", outcome.alias("outcome")))


@query("SELECT f.feed_url AS url, CASE WHEN f.id % 2 = 0 THEN f.title END AS name, lower(f.feed_type) AS type, w.id AS website_id FROM feed f JOIN website w ON w.id = f.website_id")
def listed_feeds(spark, d):
    """Feeds of each site from its list as JSON text; a name is missing from every second."""
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit(',"name":"'), "title", F.lit('"'))).otherwise("")
    item = F.concat(F.lit('{"url":"'), "feed_url", F.lit('"'), name, F.lit(',"type":"'), F.lower("feed_type"), F.lit('"}'))
    lists = site_feed(spark, d).groupBy("website_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("text"))
    return lists.select("website_id", F.explode(t.parse_json_feeds(F.col("text"))).alias("f")).select("website_id", "f.url", "f.name", "f.type")
