"""Structured Streaming forms: health state, deduplication and upserts over time."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmill.operators.ingest import classify, upsert
from quillmill.sources.schema import ERROR_LIMIT

HEALTH = "feed_id long, last_checked timestamp, last_success timestamp, error_count long, last_error string, deactivated boolean"
_STATE = "seen timestamp, good timestamp, errors long, message string, off boolean"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_rocksdb(spark: SparkSession) -> None:
    """State below is kept by RocksDB, off the heap; a query keeps the store it began with."""
    spark.conf.set(*_STORE)


class FeedHealth(StatefulProcessor):
    """One value a feed: the state machine of :mod:`quillmill.operators.health`, moved by the visits of a trigger in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.health = handle.getValueState("health", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, good, errors, message, off = self.health.get() or (None, None, 0, "", False)
        # By place: a Row looks a name up in a list of them for each value.
        for _, _, seen, success, told in sorted(rows, key=itemgetter(2, 0)):
            if success:
                good, errors, message = seen, 0, ""
            else:
                errors, message = errors + 1, told
                off = off or errors >= ERROR_LIMIT
        self.health.update((seen, good, errors, message, off))
        yield Row(feed_id=key[0], last_checked=seen, last_success=good, error_count=errors, last_error=message, deactivated=off)

    def close(self) -> None:
        pass


def health_stream(logs: DataFrame) -> DataFrame:
    """The health state of each feed after each trigger, from a stream of visit logs.

    Visits of one trigger apply in order of time and id; those of a later
    trigger come after them, whatever their time.
    """
    use_rocksdb(logs.sparkSession)
    rows = logs.select("id", "feed_id", F.col("started_at").cast("timestamp").alias("started_at"), "success", "error_message")
    return rows.groupBy("feed_id").transformWithState(FeedHealth(), HEALTH, "Update", "None")


def quiet_feeds(logs: DataFrame, quiet: str, late: str = "1 hour") -> DataFrame:
    """``feed_id, last_checked, quiet_at``: silences of feeds, each told once, when the watermark passes the end of the time allowed.

    A silence is the end of a session of visits, so built-in session windows
    keep it: state is one interval a feed that was visited within the time, and
    it goes when the silence is told.  Visits out of order count up to ``late``.
    """
    rows = logs.select("feed_id", F.col("started_at").cast("timestamp").alias("at")).withWatermark("at", late)
    sessions = rows.groupBy("feed_id", F.session_window("at", quiet).alias("w")).agg(F.max("at").alias("last_checked"))
    return sessions.select("feed_id", "last_checked", F.col("w.end").alias("quiet_at"))


def dedup_stream(entries: DataFrame, time_col: str, key: str = "url", late: str = "1 day") -> DataFrame:
    """First entry of each key within the watermark; state stays bounded."""
    return entries.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def upsert_batches(read_table, write_table, write_counts):
    """A ``foreachBatch`` function that applies each micro-batch to a stored article table."""

    def apply(batch: DataFrame, epoch: int) -> None:
        articles = read_table()
        write_counts(classify(batch, articles).groupBy("status").count(), epoch)
        write_table(upsert(articles, batch), epoch)

    return apply


def windowed_counts(logs: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: visits and failures by event-time window."""
    rows = logs.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width)).agg(F.count("*").alias("visits"), F.count_if(~F.col("success")).alias("failures"))
