"""Writing: batches of entries against stored tables.  Each function gives a new snapshot or a classified batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import blank, content_hash, moment, repaired_title, slug_title
from quillmill.sources.schema import MAX_TITLE, MAX_URL


#: What an entry writes over, even with nothing.
FIELDS = ("title", "content", "summary", "author", "published_date", "raw_data")


def classify(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """``status`` (new, updated, unchanged) of each entry of an ordered batch.

    ``batch`` has ``pos, url, title, content, summary``; ``articles`` has
    ``url, content_hash``.  Entries of one URL apply in order.  The stored hash
    moves only with an entry that has content, so an entry without content
    counts as updated whenever its own hash differs from the one kept.
    """
    w = Window.partitionBy("url").orderBy("pos")
    known = articles.select("url", F.col("content_hash").alias("_stored"), F.lit(True).alias("_known"))
    rows = batch.withColumn("hash", content_hash(F.col("title"), F.col("content"), F.col("summary"))).join(known, "url", "left")
    kept = F.last(F.when(~blank(F.col("content")), F.col("hash")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(kept, F.col("_stored"), F.lit(""))
    first = (F.row_number().over(w) == 1) & F.col("_known").isNull()
    status = F.when(first, "new").when(F.col("hash") != before, "updated").otherwise("unchanged")
    return rows.withColumn("status", status).drop("_stored", "_known")


def run_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count_if(F.col("status") == "new").alias("new_articles"), F.count_if(F.col("status") == "updated").alias("updated_articles"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))


def upsert(articles: DataFrame, batch: DataFrame, *deal: str) -> DataFrame:
    """The article table after a batch: ``url, feed_id``, the fields of ``FIELDS`` that both have, ``content_hash``.

    Each URL ends with its last entry that was not a repeat; owner and URL
    never change.  Stored rows and entries are dealt by URL together, once, and
    sorted once: a stored row comes before its entries.  Entries without a URL
    are left out.  Columns ``deal``, which follow from the URL and both have,
    stay, and rows are in order of them.  Plain Parquet has no MERGE.
    """
    fields = [c for c in FIELDS if c in batch.columns and c in articles.columns]
    hashed = ("title", "content", "summary")
    carried = [*fields, *(c for c in hashed if c not in fields)]
    none = F.lit(None)
    old = [F.col(c) if c in fields else none.alias(c) for c in carried]
    old = articles.select(*deal, "url", none.cast(batch.schema["pos"].dataType).alias("pos"), "feed_id", *old, "content_hash", F.lit(0).alias("_entry"))
    new = batch.where(F.col("url").isNotNull()).select(*deal, "url", "pos", "feed_id", *carried, none.cast("string").alias("content_hash"), F.lit(1).alias("_entry"))
    # Stored rows without a URL are no entry's: each is its own key.
    key = [*deal, "url", "_lone"]
    rows = old.withColumn("_lone", F.when(F.col("url").isNull(), F.monotonically_increasing_id())).unionAll(new.withColumn("_lone", none.cast("long"))).repartition(*key)
    # Hashes are worked out behind the shuffle: they are longer than a short entry, and nothing packs them.
    w = Window.partitionBy(*key).orderBy("_entry", "pos")
    entry, at = F.col("_entry") == 1, F.struct("_entry", "pos")
    rows = rows.withColumn("_hash", F.when(entry, content_hash(*map(F.col, hashed))))
    kept = F.when(~entry, F.coalesce("content_hash", F.lit(""))).when(~blank(F.col("content")), F.col("_hash"))
    rows = rows.withColumn("_kept", kept)
    before = F.last("_kept", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    applies = ~entry | (F.row_number().over(w) == 1) | (F.col("_hash") != F.coalesce(before, F.lit("")))
    last = rows.withColumn("_applies", applies).groupBy(*key).agg(
        F.min_by("feed_id", F.when(entry | F.col("feed_id").isNotNull(), at)).alias("feed_id"),
        F.max_by(F.struct(*fields), F.when(F.col("_applies"), at)).alias("e"),
        F.coalesce(F.max_by("_kept", F.when(F.col("_kept").isNotNull(), at)), F.lit("")).alias("content_hash"),
    )
    return last.select("url", "feed_id", "e.*", "content_hash", *deal)


def get_or_create(batch: DataFrame, table: DataFrame, key: str, order: list) -> DataFrame:
    """The rows of a batch that are to be inserted: first of each key that is not in the table."""
    fresh = batch.join(table.select(key), key, "left_anti")
    return fresh.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def enrich(feeds: DataFrame, validated: DataFrame) -> DataFrame:
    """Title and description from a validation, even empty ones; a failed validation changes nothing."""
    v = validated.select("feed_url", F.col("valid").alias("_valid"), F.col("title").alias("_title"), F.col("description").alias("_description"))
    rows = feeds.join(v, "feed_url", "left")
    ok = F.coalesce("_valid", F.lit(False))
    return rows.withColumn("title", F.when(ok, F.col("_title")).otherwise(F.col("title"))).withColumn("description", F.when(ok, F.col("_description")).otherwise(F.col("description"))).drop("_valid", "_title", "_description")


def sitemap_entries(urls: DataFrame, articles: DataFrame, as_of: datetime | Column) -> DataFrame:
    """New articles for sitemap URLs ``(pos, feed_id, feed_url, url)`` of at most ``MAX_URL`` characters."""
    usable = urls.where(F.char_length("url") <= MAX_URL)
    fresh = get_or_create(usable, articles, "url", [F.col("pos")])
    title = slug_title(F.col("url"))
    title = F.when(F.char_length(title) > MAX_TITLE, F.concat(F.left(title, F.lit(MAX_TITLE - 3)), F.lit("..."))).otherwise(title)
    now = moment(as_of)
    return fresh.select("feed_id", "url", title.alias("title"), F.concat(F.lit("Article from sitemap: "), "feed_url").alias("summary"), now.alias("published_date"))


def fill_content(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles without content that a page ``(url, page_content)`` can fill."""
    return articles.where(blank(F.col("content"))).join(pages.where(~blank(F.col("page_content"))), "url")


def backfill_batch(articles: DataFrame, limit: int = 100) -> DataFrame:
    """The next articles to fill: those of sitemap feeds; others only if there are none of these."""
    empty = articles.where(blank(F.col("content")))
    from_sitemaps = F.col("feed_type") == "SITEMAP"
    have = empty.where(from_sitemaps).limit(1).count() > 0
    return empty.where(from_sitemaps if have else ~from_sitemaps).orderBy("id").limit(limit)


def repair(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Backfilled articles with content and, where the title is only a URL, a new title."""
    filled = fill_content(articles, pages)
    return filled.withColumn("new_title", repaired_title(F.col("title"), F.col("url")))


def cross_posts(entries: DataFrame, articles: DataFrame, bridge: DataFrame) -> DataFrame:
    """``(article_id, feed_id)`` of feeds that carry an article owned by another and are not linked yet."""
    owned = articles.select(F.col("id").alias("article_id"), "url", F.col("feed_id").alias("_owner"))
    pairs = entries.select("url", "feed_id").join(owned, "url").where("feed_id <> _owner").select("article_id", "feed_id").distinct()
    return pairs.join(bridge, ["article_id", "feed_id"], "left_anti")


def multi_feed(batch: DataFrame, feeds: DataFrame) -> DataFrame:
    """``action`` for each listed feed: created, updated (an empty title gets the name) or skipped."""
    known = feeds.select("feed_url", F.col("title").alias("_title"), F.lit(True).alias("_known"))
    rows = batch.join(known, "feed_url", "left")
    action = F.when(F.col("_known").isNull(), "created").when((F.col("name") != "") & (F.col("_title") == ""), "updated").otherwise("skipped")
    description = F.when(F.col("name") != "", F.concat_ws(" - ", "site_name", "name")).otherwise("")
    return rows.select("feed_url", action.alias("action"), description.alias("description"))


def split_logs(logs: DataFrame, as_of: datetime | Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Logs kept and logs past retention (started strictly before the cutoff)."""
    cutoff = moment(as_of) - F.make_dt_interval(days=F.lit(days))
    return logs.where(F.col("started_at") >= cutoff), logs.where(F.col("started_at") < cutoff)


def open_logs(feeds: DataFrame, as_of: datetime | Column) -> DataFrame:
    """A log that has begun for each feed of ``feeds (feed_id)``; ids are the table's to give."""
    nothing = F.lit(0)
    return feeds.select("feed_id", moment(as_of).alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(False).alias("success"), nothing.alias("new_articles"), nothing.alias("updated_articles"), F.lit("").alias("error_message"))


def close_logs(opened: DataFrame, results: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Open logs closed by ``results (feed_id, error, new_articles, updated_articles)``.

    A run with an ``error`` has failed: its message is kept and its counts are
    not.  Logs without a result stay open.
    """
    r = results.select("feed_id", F.col("error").alias("_error"), F.col("new_articles").alias("_new"), F.col("updated_articles").alias("_updated"), F.lit(True).alias("_done"))
    rows = opened.join(r, "feed_id", "left")
    done, ok = F.coalesce("_done", F.lit(False)), F.col("_error").isNull()
    return rows.withColumns({
        "completed_at": F.when(done, moment(as_of)).otherwise(F.col("completed_at")), "success": F.when(done, ok).otherwise(F.col("success")),
        "new_articles": F.when(done & ok, F.col("_new").cast("int")).otherwise(F.col("new_articles")), "updated_articles": F.when(done & ok, F.col("_updated").cast("int")).otherwise(F.col("updated_articles")),
        "error_message": F.when(done & ~ok, F.col("_error")).otherwise(F.col("error_message")),
    }).drop("_error", "_new", "_updated", "_done")


def retried(tries: DataFrame, retries: int = 2) -> DataFrame:
    """``url, attempts, outcome`` of ordered tries ``(url, attempt, outcome)``: only a ``timeout`` is tried again, at most ``retries`` times."""
    last = (F.col("outcome") != "timeout") | (F.col("attempt") >= retries + 1)
    used = F.min(F.when(last, F.struct("attempt", "outcome")))
    best = tries.groupBy("url").agg(F.coalesce(used, F.max(F.struct("attempt", "outcome"))).alias("t"))
    return best.select("url", F.col("t.attempt").alias("attempts"), F.col("t.outcome").alias("outcome"))


def put_rows(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with rows created or overwritten by key; columns that ``rows`` lacks keep their values."""
    given = [c for c in rows.columns if c != key]
    new = rows.select(key, F.lit(True).alias("_given"), *(F.col(c).alias(f"_new_{c}") for c in given))
    both = table.join(new, key, "full")
    return both.select(*(F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns))
