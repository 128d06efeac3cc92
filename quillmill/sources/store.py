"""Stored tables in buckets of a key: a batch reads and rewrites only the buckets it touches.

Files lie in ``bucket=K`` folders.  A write replaces whole folders (dynamic
partition overwrite), so all others keep their files.  Every row carries the
number of the batch that last rewrote its bucket; numbers grow, so a batch that
is applied again, wholly or after a crash half way, leaves the buckets that
have it already as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, APPLIED = "bucket", "applied"


class BucketTable:
    """A table of ``schema`` below ``path``, dealt by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField(APPLIED, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        if not self._folder().exists:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _folder(self, name: str = "") -> _Folder:
        return _Folder(self.spark, f"{self.path}/{name}".rstrip("/"))

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def last_batch(self) -> int:
        """The highest number of a batch that a stored row carries; -1 in an empty table."""
        found = self._stored().agg(F.max(APPLIED)).first()[0]
        return -1 if found is None else found

    def _replace(self, rows: DataFrame, batch: int, sorted_by_bucket: bool = False) -> None:
        out = rows.select(*self.schema.names, F.lit(batch).cast("long").alias(APPLIED), F.col(BUCKET) if sorted_by_bucket else self.bucket().alias(BUCKET))
        (out if sorted_by_bucket else out.repartition(BUCKET)).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _waiting(self, touched: list[int], batch: int) -> list[int]:
        """Buckets (numbers, so at most ``buckets`` of them) that don't have the batch yet."""
        have = self._stored().where(F.col(BUCKET).isin(touched) & (F.col(APPLIED) >= batch)).select(BUCKET).distinct().collect()
        return sorted(set(touched) - {r[0] for r in have})

    def apply(self, batch: int, rows: DataFrame, merge: Callable[..., DataFrame], in_buckets: bool = False) -> list[int]:
        """Puts ``merge(stored, rows)`` in place of the buckets that ``rows`` has keys of, and says which were rewritten.

        ``merge`` keeps every key that it is given, and makes no others.  With
        ``in_buckets`` it is called as ``merge(stored, rows, BUCKET)``: both have
        that column, and its result has it and is in order of it in each
        partition, so that no shuffle is needed to write it; then a bucket has a
        file for each partition.
        """
        dealt = rows.withColumn(BUCKET, self.bucket())
        todo = self._waiting([r[0] for r in dealt.select(BUCKET).distinct().collect()], batch)
        if todo:
            mine = F.col(BUCKET).isin(todo)
            if in_buckets:
                self._replace(merge(self._stored().where(mine).select(*self.schema.names, BUCKET), dealt.where(mine), BUCKET), batch, True)
            else:
                self._replace(merge(self._stored().where(mine).select(*self.schema.names), dealt.where(mine).drop(BUCKET)), batch)
        return todo

    def delete(self, batch: int, gone: Column) -> list[int]:
        """Takes out the rows that meet ``gone``, from the buckets that have such rows; null does not meet it."""
        gone = F.coalesce(gone, F.lit(False))
        todo = [r[0] for r in self._stored().where(gone).select(BUCKET).distinct().collect()]
        if todo:
            left = self._stored().where(F.col(BUCKET).isin(todo) & ~gone)
            filled = {r[0] for r in left.select(BUCKET).distinct().collect()}
            self._replace(left.select(*self.schema.names), batch)
            for b in set(todo) - filled:  # nothing was written in their place
                self._folder(f"{BUCKET}={b}").delete()
        return sorted(todo)

    def files(self) -> dict[int, set[str]]:
        """Names of the files of each bucket that has rows; for tests and upkeep of small tables."""
        found = self._stored().select(BUCKET, F.input_file_name().alias("f")).distinct().collect()
        return {b: {r.f for r in found if r[BUCKET] == b} for b in {r[BUCKET] for r in found}}


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    @property
    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def delete(self) -> None:
        self._fs.delete(self._path, True)


class SeenKeys:
    """Keys seen in all batches so far, without a limit of time.

    A batch writes its new keys to ``bucket=B/epoch=E``; a batch that is run again
    looks only at earlier epochs and replaces its own files, so it gives the same
    rows again.  Only the buckets of the batch's keys are read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def first_seen(self, rows: DataFrame, key: str, order: list, epoch: int) -> DataFrame:
        """The first row of each key that no earlier epoch had; null keys are one key."""
        kind = "key string, bucket int, epoch long"
        keyed = rows.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("_null", F.col(key).isNull())
        keyed = keyed.withColumn("_key", F.when(F.col("_null"), F.lit("0")).otherwise(F.concat(F.lit("1"), "_key"))).drop("_null")
        best = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int"))
        fresh = best.select("_key", "_bucket").distinct()
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        seen = self.spark.read.schema(kind).parquet(self.path) if _Folder(self.spark, self.path).exists else self.spark.createDataFrame([], kind)
        seen = seen.where(F.col("bucket").isin(touched) & (F.col("epoch") < epoch)).select(F.col("key").alias("_key"))
        # Stored keys are first cut down to those of the batch: then a small batch is sent to them and they stay where they
        # are, and for a larger one Spark can test them against a Bloom filter of it before the shuffle.
        fresh = fresh.join(seen.join(fresh.select("_key"), "_key", "left_semi"), "_key", "left_anti")
        fresh.select(F.col("_key").alias("key"), F.col("_bucket").alias("bucket"), F.lit(epoch).cast("long").alias("epoch")).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(self.path)
        kept = self.spark.read.schema(kind).parquet(self.path).where(F.col("bucket").isin(touched) & (F.col("epoch") == epoch)).select(F.col("key").alias("_key"))
        # The least row of a key is found before the shuffle as well as after it.
        whole = F.struct(*order, F.struct(*rows.columns).alias("_row"))
        return best.join(kept, "_key", "left_semi").groupBy("_key").agg(F.min(whole).alias("_m")).select("_m._row.*")

    def compact(self, before: int) -> None:
        """Makes one folder a bucket of all epochs before ``before``, none of which will be run again.

        The new folders have a negative epoch that none had; the old ones are
        deleted after they are whole.  A crash between leaves keys twice, which changes nothing.
        """
        if not _Folder(self.spark, self.path).exists:
            return
        stored = self.spark.read.schema("key string, bucket int, epoch long").parquet(self.path).where(F.col("epoch") < before)
        old = stored.select("bucket", "epoch").distinct().collect()  # a folder each
        epoch = min([-1, *(r.epoch - 1 for r in old)])
        merged = stored.select("key", "bucket", F.lit(epoch).cast("long").alias("epoch")).distinct()
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(self.path)
        for r in old:
            _Folder(self.spark, f"{self.path}/bucket={r.bucket}/epoch={r.epoch}").delete()
