"""Substring search through a trigram index.

The index holds, for every three characters in a row of a lower-cased column,
lists of the ids of the rows that have them, sorted by trigram in folders by a
hash of it.  A list is of one stretch of rows of a task, so what is shuffled
and stored is an id a posting, and its trigram only once a list.  A search reads the postings of the rarest trigrams of its terms, keeps the
ids that are in all of them, and tests the rows of those ids as a scan would.
So its result is the scan's, and stale postings (of rows changed or deleted
since) do no harm; ``add`` puts in rows that are new or changed.

Terms of fewer than three characters have no trigram and don't narrow the
search; a search of such terms only is a scan.  Characters are code points of
the text in lower case, ASCII or not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import filters

#: Trigrams of a search that are looked up, the rarest ones.
LOOKED_UP = 6


#: Characters of text that are looked at together.
STRETCH = 2_000_000
_LISTS = "gram string, ids array<long>, n long"


def stretches(batches: Iterator[pa.RecordBatch], limit: int = STRETCH) -> Iterator[pa.Table]:
    """Rows in tables of about ``limit`` bytes of text; one longer row goes alone.  The first column is the id."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
        start = 0
        while start < batch.num_rows:
            end = start + int(np.searchsorted(np.cumsum(sizes[start:]), limit - size, side="right"))
            if end == start and not kept:
                end += 1
            if end > start:
                kept.append(batch.slice(start, end - start))
                size += int(sizes[start:end].sum())
            if end < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
            start = end
    if kept:
        yield pa.Table.from_batches(kept)


def id_lists(table: pa.Table) -> pa.RecordBatch:
    """For each trigram of the rows ``(id, text, ...)`` the ids that have it in some text, each once."""
    ids, row = np.unique(table.column(0).to_numpy(), return_inverse=True)
    codes, rows = [], []
    for column in table.columns[1:]:
        points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.repeat(row, pc.utf8_length(column).to_numpy())
        # Three characters are one number; those that reach over the end of a text are none.
        text = np.repeat(np.arange(len(column)), pc.utf8_length(column).to_numpy())
        whole = text[2:] == text[:-2]
        codes.append(((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[whole])
        rows.append(at[2:][whole])
    which, found = pd.factorize(np.concatenate(codes))
    pairs = np.sort(which * max(len(ids), 1) + np.concatenate(rows))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    which, rows = np.divmod(pairs, max(len(ids), 1))
    ends = np.searchsorted(which, np.arange(len(found) + 1))
    chars = np.stack([found >> 42, (found >> 21) & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    grams = pa.array([chars[k : k + 3] for k in range(0, len(chars), 3)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[rows], pa.int64()))
    return pa.RecordBatch.from_arrays([grams, lists, pa.array(np.diff(ends), pa.int64())], ["gram", "ids", "n"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(id_lists, stretches(batches))


def trigrams_of(term: str) -> set[str]:
    term = term.lower()
    return {term[k : k + 3] for k in range(len(term) - 2)}


class TrigramIndex:
    """Lists of ids by ``id_col`` for the trigrams of ``columns``, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, columns: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.id_col, self.columns, self.buckets = spark, path, id_col, list(columns), buckets

    def add(self, df: DataFrame) -> TrigramIndex:
        """Appends the postings of these rows; a null id is never found and has none.

        Rows are dealt by bucket, and a bucket that common trigrams make large is many tasks and many files.
        """
        key = F.col(self.id_col).cast("long")
        texts = df.where(key.isNotNull()).select(key.alias("id"), *(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"t{k}") for k, c in enumerate(self.columns)))
        bucket = F.pmod(F.crc32("gram"), F.lit(self.buckets)).cast("int")
        dealt = texts.mapInArrow(_listed, _LISTS).withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/lists")
        counts = self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.path}/lists").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def _of(self, name: str, kind: str, grams: list[str]) -> DataFrame:
        """Rows of these trigrams: their folders only, and within them only their row groups."""
        rows = self.spark.read.schema(f"{kind}, gram string, bucket int").parquet(f"{self.path}/{name}")
        return rows.where(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})) & F.col("gram").isin(grams))

    def candidates(self, terms: Sequence[str]) -> DataFrame | None:
        """Ids of the rows that may have all terms (each in some column); None if no term is long enough to tell."""
        grams = sorted(set().union(*map(trigrams_of, terms)))
        if not grams:
            return None
        # At most a row for each trigram of what was typed.
        counts = {r.gram: r.n for r in self._of("counts", "n long", grams).collect()}
        if len(counts) < len(grams):
            return self.spark.createDataFrame([], f"{self.id_col} long")
        rare = sorted(grams, key=lambda g: (counts[g], g))[:LOOKED_UP]
        met = self._of("lists", "ids array<long>", rare).select("gram", F.explode("ids").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("n"))
        return met.where(F.col("n") == len(rare)).select(F.col("id").alias(self.id_col))

    def _narrowed(self, df: DataFrame, terms: Sequence[str]) -> DataFrame:
        found = self.candidates(terms)
        return df if found is None else df.join(found, self.id_col, "left_semi")

    def search(self, df: DataFrame, q: str | None) -> DataFrame:
        """As ``filters.search``: rows with ``q`` in any column."""
        return filters.search(self._narrowed(df, [q]), q, *self.columns) if q else df

    def search_terms(self, df: DataFrame, q: str) -> DataFrame:
        """As ``filters.search_terms``: rows where every term of ``q`` is in some column."""
        return filters.search_terms(self._narrowed(df, q.split()), q, *self.columns)
