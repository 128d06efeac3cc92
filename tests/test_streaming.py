import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillmill.operators.health import feed_health
from quillmill.plans import parsing
from quillmill.sources import tables
from quillmill.streaming import jobs


def test_stream_of_health_is_the_batch(spark, sf_dir):
    batch = feed_health(tables.visit_log(spark, sf_dir))
    out = parsing._drained(jobs.health_stream(parsing.log_stream(spark, sf_dir)), "t", "update")
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df.select("feed_id", F.col("last_checked").cast("timestamp_ntz"), F.col("last_success").cast("timestamp_ntz"), "error_count", "last_error", "deactivated").collect())
    assert rows(batch) == rows(out)


def test_state_goes_on_over_batches(spark, tmp_path):
    kind = "id long, feed_id long, started_at timestamp, success boolean, error_message string"
    for k, pattern in enumerate(["--", "--", "-+", "-"]):
        rows = [(10 * k + j, 1, datetime(2024, 1, 1 + k, j), c == "+", "" if c == "+" else f"e{k}") for j, c in enumerate(pattern)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = parsing._drained(jobs.health_stream(stream), "t2", "update")
    states = [tuple(r) for r in out.orderBy("_epoch").select("error_count", "deactivated").collect()]
    assert states == [(2, False), (4, False), (0, True), (1, True)]


def test_upserts_by_micro_batch(spark, tmp_path):
    kind = "pos long, feed_id long, url string, title string, content string, summary string"
    store = {"articles": spark.createDataFrame([], "url string, feed_id long, title string, content string, summary string, content_hash string"), "counts": []}

    def keep(df, epoch):
        store["articles"] = spark.createDataFrame(df.collect(), df.schema)

    apply = jobs.upsert_batches(lambda: store["articles"], keep, lambda df, epoch: store["counts"].append({r.status: r["count"] for r in df.collect()}))
    apply(spark.createDataFrame([(1, 1, "u", "t", "c", "s"), (2, 1, "v", "t", "c", "s")], kind), 0)
    apply(spark.createDataFrame([(1, 1, "u", "t", "c", "s"), (2, 2, "v", "t2", "c", "s"), (3, 2, "w", "t", "c", "s")], kind), 1)
    assert store["counts"] == [{"new": 2}, {"unchanged": 1, "updated": 1, "new": 1}]
    assert {r.url: (r.title, r.feed_id) for r in store["articles"].collect()} == {"u": ("t", 1), "v": ("t2", 1), "w": ("t", 2)}


def test_runs_of_failures_in_one_trigger(spark, tmp_path):
    """Whatever the order of files, and whether a run began in an earlier trigger."""
    r = random.Random(3)
    kind = "id long, feed_id long, started_at timestamp, success boolean, error_message string"
    rows = [(k, r.choice([1, 1, 2, 3, 4]), datetime(2024, 1, 1) + timedelta(minutes=k // 2), r.random() < 0.2, f"e{k}") for k in range(240)]
    for at in (0, 80, 160):
        spark.createDataFrame(r.sample(rows[at : at + 80], 80), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = parsing._drained(jobs.health_stream(stream), "runs", "update")
    got = {x.feed_id: x.s for x in out.groupBy("feed_id").agg(F.max_by(F.struct("last_checked", "last_success", "error_count", "last_error", "deactivated"), "_epoch").alias("s")).collect()}
    for feed in (1, 2, 3, 4):
        seen = good = None
        errors, message, off = 0, "", False
        for _, _, seen, ok, text in (x for x in rows if x[1] == feed):
            errors, message, good = (0, "", seen) if ok else (errors + 1, text, good)
            off = off or errors >= 5
        assert tuple(got[feed]) == (seen, good, errors, message, off)


def test_visits_are_taken_by_place():
    kept = []

    class State:
        get, update = staticmethod(lambda: (1, 1, 3, "c", False)), staticmethod(kept.append)

    fold = jobs.FeedHealth()
    fold.health = State()
    # Tuples have no names to be looked up.
    out = list(fold.handleInputRows((5,), iter([(8, 5, 20, False, "b"), (9, 5, 20, False, "a"), (2, 5, 30, True, "")]), None))
    assert kept == [(30, 30, 0, "", True)] and out[0].asDict() == {"feed_id": 5, "last_checked": 30, "last_success": 30, "error_count": 0, "last_error": "", "deactivated": True}


def test_silences_end_at_the_next_visit(spark, tmp_path):
    kind = "feed_id long, started_at timestamp"
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    parts = [[(1, 0), (1, 9), (2, 0), (3, 5)], [(1, 18), (2, 12), (3, 14)], [(1, 17), (4, 60)], [(2, 70), (9, 200)]]
    for part in parts:
        spark.createDataFrame([(f, at(m)) for f, m in part], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = parsing._drained(jobs.quiet_feeds(stream, "10 minutes", "5 minutes"), "silences", "append")
    assert sorted((x.feed_id, x.last_checked) for x in out.collect()) == [(1, at(18)), (2, at(0)), (2, at(12)), (2, at(70)), (3, at(14)), (4, at(60))]


def test_state_is_kept_by_rocksdb(spark, tmp_path):
    kind = "id long, feed_id long, started_at timestamp, success boolean, error_message string"
    spark.createDataFrame([(1, 1, datetime(2024, 1, 1), True, "")], kind).write.parquet(str(tmp_path / "in"))
    run = jobs.health_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert any(k.startswith("rocksdb") for k in run.lastProgress["stateOperators"][0]["customMetrics"])
