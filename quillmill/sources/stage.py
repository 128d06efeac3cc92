"""Tables written between steps, below the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Stage:
    """A folder of tables of one run; lineage ends where a table is read back."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.spark = spark
        self.path = f"{(root or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/quillmill/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Deletes a table (or the whole folder) that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(conf).delete(path, True)

    def all(self, pattern: str, like: DataFrame) -> DataFrame:
        """Every table whose name meets ``pattern``, as one."""
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{pattern}")
