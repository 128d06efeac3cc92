"""Sites and feeds as stored tables, and what the commands that add feeds and discover them write.

Everything takes rows of any number of sites.  A batch has a number, and
applying it again changes nothing (see :mod:`quillmill.sources.store`).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import feed_type_from, known_type, moment
from quillmill.functions.urls import on_site, scheme_of, with_scheme
from quillmill.operators import discover
from quillmill.sources.schema import FEED, WEBSITE
from quillmill.sources.stage import Stage
from quillmill.sources.store import BucketTable


def listed(rows: DataFrame) -> DataFrame:
    """Entries ``(pos, site_url, site_name, url, name, type)`` of lists of feeds as they are stored; those without a URL go.

    Gives ``pos, site_url, feed_url, name, feed_type, description``.  Sites get
    a scheme, feeds that of their site; unknown types are RSS.
    """
    site = with_scheme(F.col("site_url"))
    name = F.coalesce("name", F.lit(""))
    about = F.when(name != "", F.concat_ws(" - ", "site_name", name)).otherwise("")
    kept = rows.where(F.coalesce("url", F.lit("")) != "")
    return kept.select("pos", site.alias("site_url"), "site_name", with_scheme(F.col("url"), scheme_of(site)).alias("feed_url"), name.alias("name"), known_type(F.col("type")).alias("feed_type"), about.alias("description"))


def list_actions(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """``pos, feed_url, action`` of listed entries in order: ``created``, ``updated`` (an empty title gets the name) or ``skipped``."""
    w = Window.partitionBy("feed_url").orderBy("pos")
    known = feeds.select("feed_url", F.col("title").alias("_title"), F.lit(True).alias("_known"))
    before = F.first(F.when(F.col("name") != "", F.col("name")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    untitled = (F.coalesce("_title", F.lit("")) == "") & before.isNull()
    action = F.when(F.col("_known").isNull() & (F.row_number().over(w) == 1), "created").when((F.col("name") != "") & untitled, "updated").otherwise("skipped")
    return entries.join(known, "feed_url", "left").select("pos", "feed_url", action.alias("action"))


class Library:
    """The tables ``website`` (by URL) and ``feed`` (by its URL) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark = spark
        self.sites = BucketTable(spark, f"{path}/website", "url", WEBSITE, buckets)
        self.feeds = BucketTable(spark, f"{path}/feed", "feed_url", FEED, buckets)

    def next_batch(self) -> int:
        return 1 + max(self.sites.last_batch(), self.feeds.last_batch())

    @staticmethod
    def _ids(table: BucketTable) -> Column:
        """New ids above all stored ones: unique, not dense."""
        return F.lit((table.read().agg(F.max("id")).first()[0] or 0) + 1) + F.monotonically_increasing_id()

    def put_sites(self, batch: int, rows: DataFrame, as_of: datetime | Column) -> list[int]:
        """Sites ``(pos, url, name)`` that are not stored yet; the first name of a URL counts, without one the URL."""
        first = rows.groupBy("url").agg(F.min_by(F.coalesce("name", "url"), "pos").alias("name"))
        new_id, now = self._ids(self.sites), moment(as_of)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            fresh = new.join(old.select("url"), "url", "left_anti")
            return old.unionByName(fresh.select(new_id.alias("id"), "url", "name", F.lit(True).alias("active"), now.alias("created_at"), now.alias("updated_at")))

        return self.sites.apply(batch, first, merge)

    def _put_feeds(self, batch: int, rows: DataFrame, as_of: datetime | Column) -> list[int]:
        """Rows ``(pos, feed_url, site_url, feed_type, title, description, given, valid, valid_title, valid_description)``.

        The first row of a URL makes its feed.  An empty title gets the first
        ``given`` one; a validation writes over title and description of feeds
        that are new or were never read.
        """
        ids = self.sites.read().select(F.col("url").alias("site_url"), F.col("id").alias("website_id"))
        own = ("website_id", "feed_type", "title", "description", "valid", "valid_title", "valid_description")
        given = F.min_by("given", F.when(F.coalesce("given", F.lit("")) != "", F.col("pos")))
        one = rows.join(ids, "site_url").groupBy("feed_url").agg(F.min_by(F.struct(*own), "pos").alias("n"), given.alias("given"))
        new_id, now = self._ids(self.feeds), moment(as_of)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.join(new, "feed_url", "full")
            is_new = F.col("id").isNull()
            told = F.coalesce("n.valid", F.lit(False)) & (is_new | F.col("last_checked").isNull())
            mine = {c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(c)) for c in ("website_id", "feed_type", "title", "description")}
            title = F.when(told, F.col("n.valid_title")).when(mine["title"] == "", F.coalesce("given", F.lit(""))).otherwise(mine["title"])
            about = F.when(told, F.col("n.valid_description")).otherwise(mine["description"])
            changed = is_new | (title != F.col("title")) | (about != F.col("description"))
            nothing = {"active": F.lit(True), "error_count": F.lit(0), "last_error": F.lit(""), "created_at": now}
            filled = {c: F.coalesce(c, v).alias(c) for c, v in nothing.items()}
            made = {**{c: v.alias(c) for c, v in mine.items()}, **filled, "id": F.coalesce("id", new_id).alias("id"), "title": title.alias("title"), "description": about.alias("description"), "updated_at": F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at")}
            return both.select(*(made.get(c, F.col(c)) for c in FEED.names))

        return self.feeds.apply(batch, one, merge)

    def add_feeds(self, batch: int, rows: DataFrame, as_of: datetime | Column) -> dict[str, int]:
        """Stores sites and feeds of lists (see :func:`listed`) and counts what became of the entries."""
        entries = listed(rows)
        self.put_sites(batch, entries.select("pos", F.col("site_url").alias("url"), F.col("site_name").alias("name")), as_of)
        counts = {r.action: r["count"] for r in list_actions(entries, self.feeds.read()).groupBy("action").count().collect()}
        none = F.lit(None).cast("string")
        self._put_feeds(batch, entries.select("pos", "feed_url", "site_url", "feed_type", F.col("name").alias("title"), "description", F.col("name").alias("given"), F.lit(False).alias("valid"), none.alias("valid_title"), none.alias("valid_description")), as_of)
        return {a: counts.get(a, 0) for a in ("created", "updated", "skipped")}

    def discover(self, batch: int, sites: DataFrame, raw: DataFrame, as_of: datetime | Column) -> int:
        """Stores what the documents ``raw (url, status, body)`` show of the stored ``sites (url)``, and says how many feeds are new.

        Feeds that pages link to or that answer on a common path come first and
        are validated; sitemaps follow.  A feed of several sites goes to the least site.
        """
        sites = sites.select("url")
        at = lambda url: sites.select(F.col("url").alias("site"), url.alias("url")).join(raw.where(F.col("status") == discover.OK).select("url", "body"), "url").select("site", "body")
        robots = at(on_site(F.col("url"), F.lit("/robots.txt")))
        found = discover.discover_all(at(F.col("url")), sites, raw)
        kind = F.when(F.col("source") == 0, feed_type_from(F.col("url"), F.col("type"))).otherwise(F.col("type"))
        feeds = found.select("site", F.col("source").cast("long").alias("source"), F.col("pos").cast("long").alias("pos"), "url", kind.alias("feed_type"), F.coalesce("title", F.lit("")).alias("title"))
        maps = discover.site_sitemap_feeds(sites, robots, raw).select("site", F.lit(2).cast("long").alias("source"), F.lit(0).cast("long").alias("pos"), "url", F.lit("SITEMAP").alias("feed_type"), "title")
        checked = discover.validated(raw).select("url", "valid", F.col("title").alias("valid_title"), F.col("description").alias("valid_description"))
        rows = feeds.unionByName(maps).join(checked, "url", "left")
        valid = F.coalesce("valid", F.lit(False)) & (F.col("feed_type") != "SITEMAP")
        rows = rows.select(F.struct("source", "site", "pos", "title").alias("pos"), F.col("url").alias("feed_url"), F.col("site").alias("site_url"), "feed_type", "title", F.lit("").alias("description"), F.lit(None).cast("string").alias("given"), valid.alias("valid"), "valid_title", "valid_description")
        stage = Stage(self.spark, "discovered")
        rows = stage.save(rows, "found")
        fresh = rows.select("feed_url").distinct().join(self.feeds.read().select("feed_url"), "feed_url", "left_anti").count()
        self._put_feeds(batch, rows, as_of)
        stage.drop()
        return fresh

    def validity(self, sites: DataFrame, raw: DataFrame) -> DataFrame:
        """``feed_url, title, valid`` of the active feeds of ``sites (url)``; a feed without a document is not valid."""
        ids = self.sites.read().join(sites.select("url").distinct(), "url", "left_semi").select(F.col("id").alias("website_id"))
        feeds = self.feeds.read().where("active").join(ids, "website_id", "left_semi")
        checked = discover.validated(raw).select(F.col("url").alias("feed_url"), "valid")
        return feeds.join(checked, "feed_url", "left").select("feed_url", F.when(F.col("title") == "", F.col("feed_url")).otherwise(F.col("title")).alias("title"), F.coalesce("valid", F.lit(False)).alias("valid"))
