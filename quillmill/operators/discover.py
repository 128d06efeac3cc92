"""Finding and reading feeds and sitemaps.  Retrieved documents come as a table ``raw_document (url, status, body)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import feeds as parsers
from quillmill.functions.html import discover_links, extract_article
from quillmill.functions.urls import FEED_PATHS, SITEMAP_PATHS, on_site, resolve
from quillmill.sources.stage import Stage

OK = 200


def pages_with_text(pages: DataFrame) -> DataFrame:
    """Pages with ``page_content``, the article's text or null."""
    return pages.withColumn("page_content", extract_article("html"))


def html_links(homes: DataFrame) -> DataFrame:
    """``site, pos, url, title, type`` for each feed that a home page ``(site, body)`` links to."""
    return homes.select("site", F.posexplode(discover_links("site", "body")).alias("pos", "l")).select("site", "pos", "l.*")


def candidates(sites: DataFrame, paths: tuple[str, ...] = FEED_PATHS) -> DataFrame:
    """Each site with each of the fixed paths, in order; a projection, not a join."""
    each = F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path")
    return sites.select(F.col("url").alias("site"), each).select("site", "pos", on_site(F.col("site"), F.col("path")).alias("url"))


def parsed_feeds(raw: DataFrame, raw_data: bool = True) -> DataFrame:
    return raw.select("url", (parsers.parse_feeds if raw_data else parsers.parse_feeds_lean)("body").alias("feed"))


def feed_entries(raw: DataFrame, raw_data: bool = True) -> DataFrame:
    """One row an entry: ``feed_url, pos`` and the article record; without ``raw_data`` that column is null and costs nothing."""
    return parsed_feeds(raw, raw_data).select(F.col("url").alias("feed_url"), F.posexplode("feed.entries").alias("pos", "e")).select("feed_url", "pos", "e.*")


def validated(raw: DataFrame) -> DataFrame:
    """``url, title, type, description, valid``; a document is valid if it has entries or describes itself."""
    feed = F.col("feed")
    ok = F.col("feed.success") & (F.coalesce(F.col("status"), F.lit(OK)) < 400)
    rows = raw.select("url", "status", parsers.parse_feeds_lean("body").alias("feed"))
    return rows.select("url", F.when(ok, feed["title"]).alias("title"), F.when(ok, feed["kind"]).alias("type"), F.when(ok, feed["description"]).alias("description"), ok.alias("valid"))


def common_path_feeds(sites: DataFrame, raw: DataFrame) -> DataFrame:
    """Feeds that answer on a common path and parse.

    ``head_status``, where documents have it, is what the probe before the
    reading got and decides alone; the status of the reading does not count then.
    """
    answer = "head_status" if "head_status" in raw.columns else "status"
    probes = candidates(sites).join(raw.where(F.col(answer) == OK), "url")
    found = probes.select("site", "pos", "url", parsers.parse_feeds_lean("body").alias("feed")).where("feed.success")
    return found.select("site", "pos", "url", F.col("feed.title").alias("title"), F.col("feed.kind").alias("type"))


def discover_all(homes: DataFrame, sites: DataFrame, raw: DataFrame) -> DataFrame:
    """Feeds of each site: linked ones first, then common paths; the first of each URL stays."""
    both = html_links(homes).select("site", F.lit(0).alias("source"), "pos", "url", "title", "type").unionByName(common_path_feeds(sites, raw).select("site", F.lit(1).alias("source"), "pos", "url", "title", "type"))
    first = both.groupBy("site", "url").agg(F.min(F.struct("source", "pos", "title", "type")).alias("f"))
    return first.select("site", "url", "f.source", "f.pos", "f.title", "f.type")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap lines of robots files ``(site, body)``, made absolute."""
    line = F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line")
    rows = robots.select("site", line).where(F.rlike("line", F.lit("(?i)^sitemap:")))
    value = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    return rows.select("site", "pos", F.when(F.rlike(value, F.lit("^https?://")), value).otherwise(resolve("site", value)).alias("url"))


def site_sitemaps(sites: DataFrame, robots: DataFrame, raw: DataFrame) -> DataFrame:
    """Sitemaps named by robots files, then those that answer on common paths."""
    named = robots_sitemaps(robots).select("site", "url", F.lit(0).alias("source"), "pos")
    probed = candidates(sites, SITEMAP_PATHS).join(raw.where(F.col("status") == OK).select("url"), "url", "left_semi").select("site", "url", F.lit(1).alias("source"), "pos")
    return named.unionByName(probed).groupBy("site", "url").agg(F.min(F.struct("source", "pos")).alias("f")).select("site", "url", "f.source", "f.pos")


def site_sitemap_feeds(sites: DataFrame, robots: DataFrame, raw: DataFrame) -> DataFrame:
    """``site, url, title`` of the sitemaps that the ones of :func:`site_sitemaps` stand for."""
    named = site_sitemaps(sites, robots, raw).select("site", F.col("url").alias("root"))
    return named.join(expand_sitemaps(named.select(F.col("root").alias("url")).distinct(), raw), "root").select("site", "url", "title")


def sitemap_pages(roots: DataFrame, raw: DataFrame) -> DataFrame:
    """``root, url`` for every page under ``roots (url)``, through child sitemaps of any depth; each sitemap counts once a root.

    Documents are parsed once, into a stored table; a level is a stored table
    of ids, and only those that no level before has go on, so cycles end.
    """
    stage = Stage(raw.sparkSession, "sitemaps")
    read = stage.save(raw.where(F.col("body").isNotNull()).select("url", parsers.parse_sitemaps("body").alias("s")).select("url", "s.pages", "s.children"), "parsed")
    level, k = stage.save(roots.select(F.col("url").alias("root"), "url").distinct(), "level-0"), 0
    while not level.isEmpty():
        k += 1
        below = level.join(read, "url").select("root", F.explode("children").alias("url")).distinct()
        level = stage.save(below.join(stage.all("level-*", level), ["root", "url"], "left_anti"), f"level-{k}")
    return stage.all("level-*", level).join(read, "url").select("root", F.explode("pages").alias("url"))


def expand_sitemaps(roots: DataFrame, raw: DataFrame, max_depth: int = 2) -> DataFrame:
    """``root, url, title`` of the sitemaps that an index stands for.

    An index is replaced by its children down to ``max_depth``; there a URL is
    given without being read.  Sitemaps that can't be read are kept and say so.
    """
    stage = Stage(raw.sparkSession, "sitemap-index")
    read = raw.select("url", F.col("body").isNotNull().alias("reached"), parsers.parse_sitemaps_ns("body").alias("s"))
    read = stage.save(read.select("url", "reached", "s"), "parsed")
    level, found = roots.select(F.col("url").alias("root"), "url"), None

    def add(rows: DataFrame) -> None:
        nonlocal found
        found = rows if found is None else found.unionAll(rows)

    for _ in range(max_depth):
        docs = level.join(read, "url", "left").withColumn("n", F.size("s.pages")).withColumn("is_index", F.coalesce(F.size("s.children") > 0, F.lit(False)))
        title = F.when(~F.coalesce("reached", F.lit(False)), "Sitemap (unreachable)").when(F.col("n") > 0, F.format_string("Sitemap (%d URLs)", "n")).otherwise("Sitemap")
        add(docs.where(~F.col("is_index")).select("root", "url", title.alias("title")))
        level = docs.where("is_index").select("root", F.explode("s.children").alias("url"))
    add(level.select("root", "url", F.lit("Sitemap").alias("title")))
    return found
