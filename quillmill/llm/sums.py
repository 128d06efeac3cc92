"""Sums of fixed-size arrays over all tasks: whole arrays by task, pieces in two levels, the total to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batches import by_text_size

#: Pieces of the array, and groups of tasks whose pieces are added first.
PIECES, GROUPS = 16, 64
_KIND = "piece int, tasks int, total binary"


def _rows(sums: dict[int, np.ndarray], tasks: int) -> pa.RecordBatch:
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([tasks] * len(sums), pa.int32()), pa.array([compress(x.tobytes()) for x in sums.values()], pa.binary())], ["piece", "tasks", "total"])


def _expand(x: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for piece, tasks, x in zip(batch.column("piece").to_pylist(), batch.column("tasks").to_pylist(), batch.column("total")):
            sums[tasks, piece] = sums.get((tasks, piece), 0) + _expand(x.as_py())
    for tasks in {t for t, _ in sums}:
        yield _rows({p: x for (t, p), x in sums.items() if t == tasks}, tasks)


def sum_arrays(rows: DataFrame, size: int, tally: Callable[[np.ndarray, pa.RecordBatch], None], text_col: str) -> np.ndarray:
    """``tally(total, batch)`` adds a batch to a task's total of ``size`` doubles; what comes back is the sum of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in by_text_size(batches, text_col):
            tally(total, batch)
        yield _rows(dict(enumerate(np.array_split(total, PIECES))), TaskContext.get().partitionId() % GROUPS)

    grouped = rows.mapInArrow(run, _KIND).repartition("piece", "tasks").mapInArrow(_add, _KIND)
    whole = grouped.selectExpr("piece", "0 AS tasks", "total").repartition("piece").mapInArrow(_add, _KIND)
    # The driver gets the array once, in pieces, whatever the number of tasks.
    found = {piece: _expand(bytes(x)) for piece, _, x in whole.collect()}
    return np.concatenate([found.get(k, np.zeros(len(p))) for k, p in enumerate(np.array_split(np.zeros(size), PIECES))])
