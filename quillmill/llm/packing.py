"""Best-fit packing of token sequences by large-item matching.

A piece longer than a third of the capacity can share a sequence with at most
one other such piece, so these are matched first: the longest takes the
longest partner that fits, which leaves the fewest sequences.  Shorter pieces
then go, longest first, to the smallest gap that holds them.

The plan depends on lengths alone.  The driver gets the histogram of piece
lengths (at most ``capacity`` rows, whatever the size of the corpus) and makes
a plan of runs: pieces of one length whose ranks lie in an interval go to
consecutive sequences at one offset.  The cluster ranks the pieces of each
length and looks the rank up, so the packing is global and no group of pieces
ever meets in one task.

Defined results: a null text is an empty text and gives the end id alone; a
null id stays null; repeated rows are packed each on their own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import by_text_size
from .encoding import ENCODE_BYTES, encoder
from .scratch import Scratch

#: Pieces of one length in one ranking chunk.
CHUNK_PIECES = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "run_length long, first_rank long, last_rank long, first_sequence long, per_sequence long, first_offset long"


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, last rank + 1, first sequence, pieces a sequence, offset)`` for a histogram of lengths."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    sequences = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    left = {x: counts[x] for x in large}
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= capacity - a and left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, sequences, 1, 0)
            left[a] -= n
            if b is not None:
                put(b, n, sequences, 1, a)
                left[b] -= n
            leave(capacity - a - (b or 0), sequences, n)
            sequences += n
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        todo = counts[s]
        while todo:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                n = -(-todo // (capacity // s))
                leave(capacity, sequences, n)
                sequences += n
                continue
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            each = min(gap // s, todo)
            take = min(n, todo // each)
            put(s, take * each, first, each, capacity - gap)
            leave(gap - each * s, first, take)
            leave(gap, first + take, n - take)
            todo -= take * each
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: whole texts are encoded, ``end_id`` appended, and only documents over ``capacity`` cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in by_text_size(batches, "text", ENCODE_BYTES):
            ids, bounds = enc.encode_column(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            many = -(-sizes // capacity)  # pieces of each document
            doc = np.repeat(np.arange(len(sizes)), many)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            first = (sizes - 1) % capacity + 1
            start = np.where(k > 0, first[doc] + (k - 1) * capacity, 0)
            length = np.where(k > 0, capacity, first[doc])
            raw = memoryview(ids.view(np.uint8))
            a = 4 * (bounds[doc] + start)
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def place(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (read more than once)."""
    spark = pieces.sparkSession
    # Ranks of a length are counted in chunks of about CHUNK_PIECES of its own pieces; rare lengths have one.
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    chunks = F.broadcast(spark.createDataFrame([(x, -(-n // CHUNK_PIECES)) for x, n in histogram.items()], "length long, _chunks long"))
    dealt = pieces.join(chunks, "length").withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_chunks"))).drop("_chunks")
    counts = scratch.save(dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n")), "counts")
    # One row for every CHUNK_PIECES pieces and one a length: each chunk gets how many pieces of its length are before it.
    before = counts.select("length", "_chunk", (F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("_n")).alias("_before")).hint("shuffle_merge")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    # The plan has a few runs for each of at most `capacity` lengths.
    plan = F.broadcast(spark.createDataFrame(plan_runs(histogram, capacity), RUNS))
    rank = F.col("_rank") + F.col("_before")
    out = ranked.join(before, ["length", "_chunk"]).withColumn("_rank", rank)
    out = out.join(plan, (F.col("length") == F.col("run_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("last_rank")))
    at = F.col("_rank") - F.col("first_rank")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(at, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into as few sequences of at most ``capacity`` tokens as the method finds."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return place(pieces, capacity, scratch)
