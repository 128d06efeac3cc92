"""Predicates and searches.  Values are bound as literals; SQL text is never put together from them."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import blank, contains_ci, moment


def any_contains(q: str, *columns: str) -> Column:
    return reduce(or_, (contains_ci(F.col(c), q) for c in columns))


def search(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Rows with ``q`` in any of the columns; no query, no filter."""
    return df.where(any_contains(q, *columns)) if q else df


def search_terms(df: DataFrame, q: str, *columns: str) -> DataFrame:
    """Rows where every term of ``q`` is in some column."""
    return df.where(reduce(and_, (any_contains(t, *columns) for t in q.split()), F.lit(True)))


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value)).limit(1)


def active_filter(df: DataFrame, value: str | None) -> DataFrame:
    """``true`` and ``false`` filter; anything else does not."""
    return df.where(F.col("active") == F.lit(value == "true")) if value in ("true", "false") else df


def date_range(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Between two dates taken as midnight, so later hours of ``last`` are out; null dates drop out."""
    if first:
        df = df.where(F.col(column) >= F.to_timestamp_ntz(F.lit(first), F.lit("yyyy-MM-dd")))
    if last:
        df = df.where(F.col(column) <= F.to_timestamp_ntz(F.lit(last), F.lit("yyyy-MM-dd")))
    return df


def since(df: DataFrame, column: str, as_of: datetime | Column, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows at or after ``as_of`` less a span."""
    return df.where(F.col(column) >= moment(as_of) - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours)))


def missing_content(articles: DataFrame) -> DataFrame:
    return articles.where(blank(F.col("content")))


def stale(feeds: DataFrame, before: datetime | Column) -> DataFrame:
    """Active feeds not looked at since ``before``, or never."""
    seen = F.col("last_checked")
    return feeds.where(F.col("active") & (seen.isNull() | (seen < moment(before))))


def same_content(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """Entries whose URL and hash are stored already."""
    return batch.join(articles.select("url", "content_hash"), ["url", "content_hash"], "left_semi")


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """``facet, value, n`` for each column, in one pass over the data."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def ranked_lookup(df: DataFrame, terms: DataFrame) -> DataFrame:
    """For each of a few ``term``s (broadcast: they are typed by hand) the first row by name that has it in its name, else in its URL."""
    name, url = F.col("name"), F.col("url")
    how = F.when(F.contains(F.lower(name), F.lower("term")), 0).when(F.contains(F.lower(url), F.lower("term")), 1)
    met = df.join(F.broadcast(terms), F.contains(F.lower(name), F.lower("term")) | F.contains(F.lower(url), F.lower("term")))
    best = met.groupBy("term").agg(F.min(F.struct(how.alias("how"), name, F.col("id"))).alias("b"))
    return best.select("term", F.col("b.id").alias("id"), F.col("b.name").alias("name"))


def exactly_one(df: DataFrame) -> tuple[object | None, DataFrame]:
    """The only row, or None with the rows to choose from."""
    few = df.limit(2).collect()
    return (few[0] if len(few) == 1 else None), df


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def only_matches(df: DataFrame, column: str, terms: list[str], show: str) -> DataFrame:
    """``term, single`` and ``show`` of the only row whose ``column`` contains the term (empty if there are none or several), in one pass."""
    each = []
    for term in terms:
        hit = F.coalesce(F.contains(column, F.lit(term)), F.lit(False))
        single = F.count_if(hit) == 1
        each.append(F.struct(F.lit(term).alias("term"), single.alias("single"), F.when(single, F.min(F.when(hit, F.col(show)))).otherwise("").alias(show)))
    return df.agg(F.array(*each).alias("found")).select(F.inline("found"))


def having(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``value, found`` for each value: whether any row has it, in one pass."""
    each = [F.struct(F.lit(v).alias("value"), (F.count_if(F.col(column) == v) > 0).alias("found")) for v in values]
    return df.agg(F.array(*each).alias("found")).select(F.inline("found"))


def article_list(articles: DataFrame, params: dict[str, str]) -> DataFrame:
    """Articles with feed and site by request parameters: ``search, website, feed, date_from, date_to``; empty ones don't count."""
    for name, column in (("website", "website_id"), ("feed", "feed_id")):
        if value := params.get(name):
            articles = articles.where(F.col(column) == int(value))
    articles = search(articles, params.get("search"), "title", "summary", "author")
    return date_range(articles, "published_date", params.get("date_from"), params.get("date_to"))


def feed_list(feeds: DataFrame, params: dict[str, str]) -> DataFrame:
    """Feeds with their site by request parameters: ``website, type, active, search``."""
    if value := params.get("website"):
        feeds = feeds.where(F.col("website_id") == int(value))
    if value := params.get("type"):
        feeds = feeds.where(F.col("feed_type") == value)
    return search(active_filter(feeds, params.get("active")), params.get("search"), "title", "feed_url", "site_name")


def new_content(full: DataFrame, as_of: datetime | Column, hours: int = 24, website: str | None = None) -> DataFrame:
    """Articles (with feed and site) of the last hours, of the sites with ``website`` in their name or URL."""
    return search(since(full, "retrieved_at", as_of, hours=hours), website, "site_name", "site_url")
