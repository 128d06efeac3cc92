"""Arrow batches cut into pieces of bounded text size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text handled at once by a Python worker; one longer text goes alone.
CHUNK_BYTES = 1 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to 4 MB for the session, unless it has a limit of its own: a batch of the
    default 64 MB is held several times over by the JVM and the worker."""
    if spark.conf.get(_BATCH_LIMIT) == "67108864b":
        spark.conf.set(_BATCH_LIMIT, str(4 << 20))


def give_back() -> None:
    """Returns memory that a worker has freed to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def by_text_size(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` whose ``column`` holds about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])
    give_back()


def by_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` with ``limit`` rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            yield batch.slice(at, limit)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column in one array, and the ``n + 1`` row bounds; null is empty."""
    col = batch.column(column)
    col = col.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    bounds = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]
