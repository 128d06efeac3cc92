"""Shared scratch space for intermediate tables.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` (shared by
the driver and all executors), never with a local checkpoint: a lost executor
then costs a re-read, not a failed job.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .batches import bound_batches


def scratch_root(spark: SparkSession) -> str:
    """The session's shared folder; only a local master, which is one machine, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


class Scratch:
    """A folder of tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.path = f"{scratch_root(spark)}/quillmill/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        to = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(to)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one table (or all) that later steps no longer read."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(conf).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

