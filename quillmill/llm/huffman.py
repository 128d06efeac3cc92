"""Token ids in files of canonical, length-limited Huffman codes.

Files: one row a block, in ascending order of document id.  A block is bytes
that can be decoded alone (with the code lengths): a header, the document
ids and lengths, a bit offset for every ``CHECKPOINT`` symbols, and the bit
stream.  Decoding reads a table by the next ``limit`` bits; the stretches
between checkpoints advance together, one symbol each at a time, so a block
decodes in ``CHECKPOINT`` vector steps.

Codes come from global counts: package-merge gives the best lengths of at most
``limit`` bits, and codes are dealt in order of length and id, so the lengths
alone (one byte an id of the vocabulary) restore the code.

Defined results: null text is empty text (the end id alone); rows with a null
id come first; rows that share an id keep their own entries, next to each
other; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_rows, by_text_size
from .encoding import ENCODE_BYTES, encoder
from .ranges import id_bounds, with_range
from .scratch import Scratch, shuffle_width

LIMIT = 18
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 19
MAGIC = b"QHF1"
HEADER = struct.Struct("<4sIQQQ")  # magic, documents, tokens, bits, ids before the block in its part
NO_ID = -(1 << 63)
STORED = "doc_id long, n_tokens long, ids binary"
BLOCKS = "part int, block int, n_tokens long, payload binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for each symbol (0: not used), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels = []  # at each level: is the item, in order of weight, a package?
    packages = np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank >= len(leaves))
        merged = weights[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    need, found = 2 * len(used) - 2, np.zeros(len(used), dtype=np.int64)
    for packed in reversed(levels):
        taken = int(packed[:need].sum())
        found[: need - taken] += 1
        need = 2 * taken
    lengths[order] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    if len(order):
        width = int(size[-1])
        # Each code is the count of `width`-bit words before it, cut to its length.
        before = np.concatenate([[0], np.cumsum(np.int64(1) << (width - size))[:-1]])
        codes[order] = (before >> (width - size)).astype(np.uint64)
    return codes


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.codes = canonical_codes(lengths)
        self.packed = self.codes << np.uint64(8) | lengths.astype(np.uint64)
        self.limit = max(1, int(lengths.max(initial=1)))
        self._table: np.ndarray | None = None

    def table(self) -> np.ndarray:
        """For every ``limit`` bits that may come next: the symbol, shifted by 8, and its code length."""
        if self._table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            span = np.int64(1) << (self.limit - self.lengths[order].astype(np.int64))
            self._table = np.ones(1 << self.limit, dtype=np.uint32)
            self._table[: int(span.sum())] = np.repeat((order << 8 | self.lengths[order]).astype(np.uint32), span)
        return self._table


def encode_block(doc_ids: list[int], n_tokens: list[int], ids: np.ndarray, before: int, book: Codebook) -> bytes:
    code = book.packed.take(ids)
    size = (code & np.uint64(255)).astype(np.int64)
    ends = np.cumsum(size)
    bits = int(ends[-1])
    starts = ends - size
    word = starts >> 5
    # Codes lie in 64-bit windows that open at 32-bit words; every word but the last opens some code.
    firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    windows = np.add.reduceat(code >> np.uint64(8) << (64 - size - (starts & 31)).view(np.uint64), firsts)
    words = np.zeros(len(firsts) + 1, dtype=np.uint64)
    words[:-1] = windows >> np.uint64(32)
    words[1:] += windows & np.uint64(0xFFFFFFFF)
    stream = words.astype(">u4").tobytes()[: (bits + 7) // 8]
    head = HEADER.pack(MAGIC, len(doc_ids), len(ids), bits, before)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(n_tokens, "<i8").tobytes(), starts[::CHECKPOINT].astype("<u8").tobytes(), stream])


def decode_block(payload: bytes, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, token counts, all ids, and the ids before the block in its part."""
    magic, docs, tokens, bits, before = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEADER.size
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    counts = np.frombuffer(payload, "<i8", docs, at + 8 * docs)
    lanes = -(-tokens // CHECKPOINT)
    place = np.frombuffer(payload, "<u8", lanes, at + 16 * docs).astype(np.int64)
    raw = np.frombuffer(payload, np.uint8, offset=at + 16 * docs + 8 * lanes)
    raw = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    table = book.table()
    out = np.empty((CHECKPOINT, lanes), dtype=np.uint32)
    last, keep, drop = len(window) - 1, np.uint32((1 << book.limit) - 1), 32 - book.limit
    for k in range(CHECKPOINT):
        seen = window[np.minimum(place >> 3, last)] >> (drop - (place & 7)).astype(np.uint32) & keep
        found = table.take(seen, out=out[k])
        place += found & np.uint32(255)
    out >>= np.uint32(8)
    return doc_ids, counts, out.T.reshape(-1)[:tokens], before


def _squeeze(packed: list) -> list[bytes]:
    """Compressed: stored ids wait here only for the counts."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    return [compress(x) for x in packed]


def _expand(stored: Iterable[pa.Scalar], dtype: str) -> list[np.ndarray]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress  # one context for all rows
    return [np.frombuffer(expand(x.as_py()), dtype) for x in stored]


def stored_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded documents; a task's last row (``n_tokens`` -1) holds its count of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        total = np.zeros(max(enc.size, end_id + 1), dtype=np.int64)
        names = ["doc_id", "n_tokens", "ids"]
        for batch in by_text_size(batches, "text", ENCODE_BYTES):
            ids, bounds = enc.encode_column(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id)
            total += np.bincount(ids, minlength=len(total))
            bounds = bounds + np.arange(len(bounds))
            cuts, raw = (bounds * enc.dtype.itemsize).tolist(), memoryview(ids.view(np.uint8))
            packed = _squeeze([raw[x:y] for x, y in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(packed, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array(_squeeze([total.tobytes()]), pa.binary())], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, STORED)


def count_ids(stored: DataFrame, size: int) -> np.ndarray:
    """Global count of each id; at most one row an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for counts in _expand(batch.column("ids"), "<i8"):
                total += counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for i, n in stored.where("n_tokens < 0").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    return counts


def write_blocks(stored: DataFrame, dtype: str, book: Codebook) -> DataFrame:
    """Blocks of documents in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, waiting = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[int] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, waiting
            ids = np.concatenate(held)
            payload = encode_block(docs, sizes, ids, before, book)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "n_tokens", "payload"])
            block, before, waiting = block + 1, before + len(ids), 0
            docs.clear(), sizes.clear(), held.clear()
            return out

        for batch in by_rows(batches, 1000):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), _expand(batch.column("ids"), dtype))
            for doc, n, ids in rows:
                docs.append(NO_ID if doc is None else doc)
                sizes.append(n)
                held.append(ids)
                waiting += n
                if waiting >= BLOCK_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    rows, parts = stored.where("n_tokens >= 0"), shuffle_width(stored.sparkSession)
    bounds, _ = id_bounds(rows, "doc_id", parts)
    order = with_range(rows, "doc_id", bounds, "_part").repartitionById(parts, F.col("_part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return order.select("doc_id", "n_tokens", "ids").mapInArrow(run, BLOCKS)


def read_blocks(blocks: DataFrame, book: Codebook) -> DataFrame:
    """Per document, decoded from the files: id, ids before it, its ids' count and checksum."""
    # One number a part (an output partition), not a document.
    parts = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, total = {}, 0
    for part, n in parts:
        base[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload")):
                docs, counts, ids, before = decode_block(payload.as_py(), book)
                ends = np.cumsum(counts)
                starts = ends - counts
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(starts + before + base[part], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "payload").mapInArrow(run, RESULT)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Codebook:
    """Writes ``path/blocks`` and ``path/codebook`` and returns the code."""
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    scratch = Scratch(spark, "ids")
    stored = scratch.save(stored_ids(docs, tokenizer, end_id, id_col, text_col), "stored")
    book = Codebook(code_lengths(count_ids(stored, max(enc.size, end_id + 1))))
    write_blocks(stored, enc.dtype.str, book).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(book.lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    scratch.drop()
    return book


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()[0]), np.uint8).copy()
    return read_blocks(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), Codebook(lengths))
