from datetime import datetime

from pyspark.sql import functions as F

from quillmill.functions.text import content_hash
from quillmill.operators import filters, ingest, schedule, stats
from quillmill.operators.health import feed_health

T0 = datetime(2024, 1, 1)
LOG = "id long, feed_id long, started_at timestamp_ntz, success boolean, error_message string"


def logs(spark, pattern):
    """``+`` and ``-`` for successes and failures of one feed, an hour apart."""
    return spark.createDataFrame([(k, 1, datetime(2024, 1, 1, k), c == "+", "" if c == "+" else f"e{k}") for k, c in enumerate(pattern)], LOG)


def state(spark, pattern):
    r = feed_health(logs(spark, pattern)).first()
    return r.error_count, r.last_error, r.deactivated


def test_runs_of_errors(spark):
    assert state(spark, "----") == (4, "e3", False)
    assert state(spark, "-----") == (5, "e4", True)
    assert state(spark, "-----+") == (0, "", True)
    assert state(spark, "+--+-") == (1, "e4", False)


def test_success_rate_uses_the_last_twenty(spark):
    feeds = spark.createDataFrame([(1,), (2,)], "id long")
    rows = {r.id: r for r in stats.success_rate(feeds, logs(spark, "----" + "+" * 19 + "-")).collect()}
    assert (rows[1].success_rate, rows[1].logs) == (95.0, 20)
    assert (rows[2].success_rate, rows[2].logs) == (0.0, 0)


ENTRY = "pos long, feed_id long, url string, title string, content string, summary string"
STORED = "url string, feed_id long, title string, content string, summary string, content_hash string"


def test_fold_over_one_batch(spark):
    same = spark.range(1).select(content_hash(F.lit("t"), F.lit("c"), F.lit("s"))).first()[0]
    stored = spark.createDataFrame([("u1", 1, "t", "c", "s", same), ("u2", 1, "t", "", "s", "")], STORED)
    batch = spark.createDataFrame(
        [(1, 9, "u1", "t", "c", "s"), (2, 9, "u1", "t2", "c", "s"), (3, 9, "u1", "t2", "c", "s"), (4, 9, "u2", "t", "", "s"), (5, 9, "u2", "t", "", "s"), (6, 9, "u3", "n", "", ""), (7, 9, "u3", "n", "", "")], ENTRY
    )
    got = [r.status for r in ingest.classify(batch, stored).orderBy("pos").collect()]
    assert got == ["unchanged", "updated", "unchanged", "updated", "updated", "new", "updated"]
    after = {r.url: r for r in ingest.upsert(stored, batch).collect()}
    assert (after["u1"].title, after["u1"].feed_id) == ("t2", 1)
    assert after["u3"].feed_id == 9 and after["u3"].content_hash == ""


def test_second_upsert_changes_nothing(spark):
    batch = spark.createDataFrame([(k, 1, f"u{k}", "t", "c", "s") for k in range(5)], ENTRY)
    empty = spark.createDataFrame([], STORED)
    once = ingest.upsert(empty, batch)
    assert ingest.run_counts(ingest.classify(batch, empty)).first()[:2] == (5, 0)
    assert ingest.run_counts(ingest.classify(batch, once)).first()[:2] == (0, 0)


def test_date_range_ends_at_midnight(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 3, 1)), (2, datetime(2024, 3, 1, 0, 0, 1)), (3, None), (4, datetime(2024, 2, 1))], "id long, d timestamp_ntz")
    assert {r.id for r in filters.date_range(rows, "d", "2024-02-01", "2024-03-01").collect()} == {1, 4}


def test_days_before_today(spark):
    a = spark.createDataFrame([(datetime(2024, 1, 10, 5),), (datetime(2024, 1, 9, 23, 59),), (datetime(2024, 1, 7),)], "retrieved_at timestamp_ntz")
    got = [tuple(r) for r in stats.articles_per_day(a, datetime(2024, 1, 10, 12), 3).orderBy("date").collect()]
    assert got == [("2024-01-07", 1), ("2024-01-08", 0), ("2024-01-09", 1)]
    assert stats.articles_per_day(a, datetime(2024, 1, 10), 0).count() == 0


def test_backfill_takes_others_only_without_sitemaps(spark):
    rows = [(1, "", "RSS"), (2, "", "RSS"), (3, "text", "SITEMAP")]
    kind = "id long, content string, feed_type string"
    assert [r.id for r in ingest.backfill_batch(spark.createDataFrame(rows, kind)).collect()] == [1, 2]
    assert [r.id for r in ingest.backfill_batch(spark.createDataFrame([*rows, (4, None, "SITEMAP")], kind)).collect()] == [4]


def test_enrich_keeps_titles_of_failed_validations(spark):
    feeds = spark.createDataFrame([("a", "old", "d"), ("b", "old", "d"), ("c", "old", "d")], "feed_url string, title string, description string")
    seen = spark.createDataFrame([("a", True, "", ""), ("b", False, "x", "y")], "feed_url string, valid boolean, title string, description string")
    assert {r.feed_url: r.title for r in ingest.enrich(feeds, seen).collect()} == {"a": "", "b": "old", "c": "old"}


def test_entries_write_over_author_date_and_raw_data(spark):
    kind = "url string, feed_id long, title string, content string, summary string, author string, published_date timestamp_ntz, raw_data string, content_hash string"
    stored = spark.createDataFrame([("u", 1, "t", "c", "s", "Ann", T0, "{}", "old"), ("v", 1, "t", "c", "s", "Bob", T0, "{}", "old")], kind)
    batch = spark.createDataFrame([(1, 2, "u", "t", "c", "s", "", None, '{"a":1}')], "pos long, feed_id long, url string, title string, content string, summary string, author string, published_date timestamp_ntz, raw_data string")
    got = {r.url: r for r in ingest.upsert(stored, batch).collect()}
    assert (got["u"].feed_id, got["u"].author, got["u"].published_date, got["u"].raw_data) == (1, "", None, '{"a":1}')
    assert (got["v"].author, got["v"].published_date) == ("Bob", T0)


def moved(df):
    """Shuffles of the plan by which rows are dealt."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"), df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_an_upsert_deals_rows_once(spark, tmp_path):
    spark.createDataFrame([("u", 1, "t", "c", "s", "h")], STORED).write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(1, 9, "u", "t", "c", "s")], ENTRY).write.parquet(f"{tmp_path}/b")
    assert moved(ingest.upsert(spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/b"))) == (1, 1)


def test_random_batches_fold_as_plain_code_does(spark):
    import random
    from hashlib import sha256

    r = random.Random(3)
    text = lambda: r.choice(["", None, "a", "b"])
    digest = lambda *xs: sha256("".join(x or "" for x in xs).encode()).hexdigest()
    stored = [(f"u{k}", k, *(x := (text(), text(), text())), r.choice([None, "", digest(*x)])) for k in range(40)] + [(None, 7, "t", "c", "s", "h"), (None, 8, "t", "c", "s", "h")]
    batch = [(pos, r.randrange(100, 200), r.choice([f"u{r.randrange(60)}", None]) if pos % 9 == 0 else f"u{r.randrange(60)}", text(), text(), text()) for pos in range(300)]
    want = {u: [feed, x, h or ""] for u, feed, *x, h in stored if u}
    for _, feed, u, *x in batch:
        if not u:
            continue
        known, h = u in want, digest(*x)
        now = want.setdefault(u, [feed, x, ""])
        if not known or h != now[2]:
            now[1] = x
        if x[1]:
            now[2] = h
    rows = spark.createDataFrame(batch, ENTRY).repartition(5)
    got = ingest.upsert(spark.createDataFrame(stored, STORED), rows).collect()
    assert {x.url: [x.feed_id, [x.title, x.content, x.summary], x.content_hash] for x in got if x.url} == want
    assert sorted(x.feed_id for x in got if not x.url) == [7, 8] and len(got) == len(want) + 2


def test_waits_reach_over_slots(spark):
    at = [datetime(2024, 1, 1, 0, 59, 59, 500_000), datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 1, 0, 0, 250_000), datetime(2024, 1, 1, 5)]
    rows = spark.createDataFrame([(k, "h", x) for k, x in enumerate(at)], "id long, host string, at timestamp")
    assert [r.wait_s for r in stats.request_delays(rows).orderBy("id").collect()] == [0.0, 0.5, 0.75, 0.0]


def test_tries(spark):
    rows = [("a", 1, "ok"), ("b", 1, "timeout"), ("b", 2, "http_error"), ("b", 3, "ok"), *(("c", k, "timeout") for k in range(1, 6)), ("d", 1, "timeout")]
    got = {r.url: (r.attempts, r.outcome) for r in ingest.retried(spark.createDataFrame(rows, "url string, attempt int, outcome string")).collect()}
    assert got == {"a": (1, "ok"), "b": (2, "http_error"), "c": (3, "timeout"), "d": (1, "timeout")}


def test_requests_of_sites_have_outcomes(spark):
    sites = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    feeds = spark.createDataFrame([(10, 1, True), (11, 1, False), (12, 1, True), (13, 2, False), (14, 7, True)], "id long, website_id long, active boolean")
    asked = spark.createDataFrame([(1,), (2,), (7,), (None,)], "website_id long")
    rows = {r.website_id: (r.name, r.outcome, r.feeds) for r in schedule.site_outcomes(asked, sites, feeds).collect()}
    assert rows == {1: ("A", "queued", 2), 2: ("B", "no_active_feeds", 0), 7: (None, "not_found", 0), None: (None, "not_found", 0)}
    twice = asked.unionAll(asked)
    assert sorted(r.feed_id for r in schedule.site_work(twice, sites, feeds).collect()) == [10, 12]
    assert schedule.site_outcomes(asked.limit(0), sites, feeds).isEmpty()
    assert [r.id for r in schedule.created(sites, spark.createDataFrame([(2, "b"), (3, "c")], "id long, name string")).collect()] == [3]
