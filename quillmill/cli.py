"""``python -m quillmill.cli``: lists registered queries, runs one and shows or writes its rows, shows what a command asks for, or stores feeds."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.urls import with_scheme
from quillmill.operators import filters, stats
from quillmill.operators.ingest import backfill_batch
from quillmill.operators.library import Library
from quillmill.plans import catalog
from quillmill.plans.relational import full_articles, site_feed
from quillmill.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill")
    todo = p.add_subparsers(dest="command", required=True)
    todo.add_parser("list", help="names of queries")
    run = todo.add_parser("run", help="run a query")
    run.add_argument("query")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="where to write; without it the first rows are shown")
    run.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    run.add_argument("--explain", action="store_true", help="show the plan only")
    new = todo.add_parser("new-content", help="articles of the last hours")
    new.add_argument("--hours", type=int, default=24)
    new.add_argument("--website", help="part of a site's name or URL")
    missing = todo.add_parser("missing-content", help="the next articles to fill")
    missing.add_argument("--limit", type=int, default=100)
    missing.add_argument("--website", help="part of a site's name")
    due = todo.add_parser("due-feeds", help="active feeds to read")
    due.add_argument("--feed-id", type=int)
    due.add_argument("--website", help="part of a site's name or URL")
    add = todo.add_parser("add-feeds", help="store a site's feeds from a list")
    add.add_argument("--website-url", required=True)
    add.add_argument("--website-name", required=True)
    lists = add.add_mutually_exclusive_group(required=True)
    lists.add_argument("--feeds-json", help="a JSON array of {url, name, type}")
    lists.add_argument("--feeds-file", help="a file that holds such an array")
    add.add_argument("--validate", action="store_true", help="say which of the site's active feeds the documents show to be valid")
    find = todo.add_parser("discover-feeds", help="store the feeds and sitemaps that documents show of a site")
    find.add_argument("website_url")
    find.add_argument("--name", help="name of the site if it is new")
    for command in (add, find):
        command.add_argument("--library", required=True, help="folder of the stored tables")
        command.add_argument("--documents", required=command is find, help="Parquet folder of retrieved documents (url, status, body)")
        command.add_argument("--batch", type=int, help="number of the batch; by default the next")
        command.add_argument("--as-of", type=datetime.fromisoformat, help="the time that is written; by default now (UTC)")
    for command in (new, missing, due):
        command.add_argument("--data", required=True, help="folder of the tables")
    return p


def chosen(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The rows that a command's parameters ask for."""
    if args.command == "due-feeds":
        feeds = filters.search(site_feed(spark, args.data).where("active"), args.website, "site_name", "site_url")
        return feeds.where(F.col("id") == args.feed_id) if args.feed_id is not None else feeds
    full = full_articles(spark, args.data)
    if args.command == "new-content":
        return filters.new_content(full, stats.latest(tables.article(spark, args.data), "retrieved_at"), args.hours, args.website).orderBy(F.desc("retrieved_at"), "id")
    return backfill_batch(filters.search(full, args.website, "site_name"), args.limit)


def store(spark: SparkSession, args: argparse.Namespace) -> tuple[str, DataFrame]:
    """Runs a command that writes; says what it did and shows the feeds that it is about."""
    library, as_of = Library(spark, args.library), args.as_of or datetime.now(UTC).replace(tzinfo=None)
    batch = library.next_batch() if args.batch is None else args.batch
    site = spark.range(1).select(with_scheme(F.lit(args.website_url)).alias("url"))
    raw = spark.read.parquet(args.documents) if args.documents else spark.createDataFrame([], "url string, status int, body string")
    if args.command == "add-feeds":
        text = spark.range(1).select(F.lit(args.feeds_json).alias("value")) if args.feeds_json is not None else spark.read.text(args.feeds_file, wholetext=True)
        entries = text.select(F.posexplode(tables.parse_json_feeds(F.col("value"))).alias("pos", "f"))
        rows = entries.select("pos", F.lit(args.website_url).alias("site_url"), F.lit(args.website_name).alias("site_name"), "f.*")
        if rows.isEmpty():
            raise SystemExit("no feeds: the list is empty or no JSON array")
        said = ", ".join(f"{n} {action}" for action, n in library.add_feeds(batch, rows, as_of).items())
        if args.validate:
            return said, library.validity(site, raw)
    else:
        library.put_sites(batch, site.select(F.lit(0).alias("pos"), "url", F.lit(args.name or None).cast("string").alias("name")), as_of)
        said = f"{library.discover(batch, site, raw, as_of)} new feeds"
    ids = library.sites.read().join(site, "url", "left_semi").select(F.col("id").alias("website_id"))
    return said, library.feeds.read().join(ids, "website_id", "left_semi").select("feed_type", "feed_url", "title").orderBy("feed_url")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    queries = catalog.queries()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if args.command in ("add-feeds", "discover-feeds"):
        said, rows = store(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)
        print(said)
        rows.show(20, truncate=False)
        return 0
    if args.command != "run":
        chosen(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args).show(20, truncate=False)
        return 0
    if args.query not in queries:
        print(f"no query {args.query!r}")
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = queries[args.query](spark, args.data)
    if args.explain:
        df.explain("formatted")
    elif args.out:
        df.write.mode("overwrite").format(args.format).save(args.out)
    else:
        df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
