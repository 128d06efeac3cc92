"""Connected components by least labels and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``; the label is the least node of its component.

    Each round a node takes the least label around it and then its label's
    label, so rounds grow with the logarithm of a component's width.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.save(both, f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ends = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = moved.join(ends, F.col("label") == F.col("_n"), "left").select("node", "old", F.least("label", F.coalesce("_l", "label")).alias("label"))
        new = scratch.save(jumped, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels
