"""Exact removal of repeated 13-word windows by super-k-mer partitioning.

Each window's minimiser is the least hash of its word pairs.  Consecutive
windows that share it travel as one packed string (a super-k-mer) to the
bucket of that minimiser, so a word moves about three times rather than
thirteen, and equal windows always meet.  A task packs what it has for a
bucket into one compressed row.  In the bucket the windows are sorted by hash;
runs of equal ones are compared byte by byte with the one of the least
document, and what is not its first document's is reported as intervals of
words.  A last join by document takes the intervals out.

Hot windows and minimisers stay bounded:

* what repeats within a piece of the input (``MAP_BYTES``) is reported there, and
  only the least document's windows travel, so copies of a passage weigh as
  much as pieces, not documents;
* a sample of texts tells which minimisers would fill more than a bucket
  (boilerplate with other words around it); their windows travel one by one, by
  the hash of the whole window.  The sample decides balance only;
* a bucket that holds more than ``HELD_BYTES`` is settled as far as it has come,
  and only the least documents' windows are held on.

The number of buckets follows the size of the corpus; a bucket is dealt to a
task by its number.

Defined results: null text has no words; windows of one document never remove
each other, nor do those of rows that share an id; a null id counts as the
greatest; repeated rows get the same result each; texts under 13 words are
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_text_size, bytes_of
from .scratch import Scratch, shuffle_width
from .words import Words, mix, runs_of, shingle_hashes

WINDOW = 13
#: Text bytes a map task packs at once, and packed bytes a bucket should hold.
MAP_BYTES, BUCKET_BYTES = 3 << 20, 4 << 20
#: Unpacked bytes that a bucket's task holds before it settles them; settling takes about fifty times as much.
HELD_BYTES = 7 << 20
#: Text bytes at least, and share of the corpus, that are looked at for hot minimisers; so many are told apart at most.
SAMPLE_BYTES, SAMPLE_SHARE, HOT = 16 << 20, 0.01, 50_000
LAST = (1 << 63) - 1
PACKED = "part int, bucket int, payload binary"
FOUND = "doc_id long, text_key long, intervals binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _pack(parts: list[np.ndarray], text: bytes) -> bytes:
    import zstandard

    head = np.array([len(parts[0]), len(text)], "<i8").tobytes()
    # Numbers by planes of bytes, of which the upper ones repeat.
    planes = np.stack([p.astype("<i8") for p in parts]).view(np.uint8).reshape(len(parts), len(parts[0]), 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=6).compress(b"".join([head, planes.tobytes(), text]))


def _unpack(payload: bytes) -> tuple[np.ndarray, bytes]:
    """Rows of document, text key, first word and packed length; and the packed words."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    planes = np.frombuffer(raw, np.uint8, 32 * n, 16).reshape(4, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(4, n), raw[16 + 32 * n :]


def super_kmers(words: Words, window: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end window and minimiser of each stretch of windows (of ``keep``) that share one."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    pairs = shingle_hashes(words.hash, 2)
    least, width = pairs, 1
    while 2 * width <= window - 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = window - 1 - width  # windows of `width` pairs, moved on by the rest, cover all of them
    least = np.minimum(least[: len(least) - rest], least[rest:])[:n]
    whole = words.text[:n] == words.text[window - 1 :]
    if keep is not None:
        whole &= keep
    a, b = runs_of(least)
    edge_a, edge_b = runs_of(np.where(whole, words.text[:n], -1))
    cuts = np.union1d(a, edge_a)
    ends = np.append(cuts[1:], n)
    keep = whole[cuts]
    return cuts[keep], ends[keep], least[cuts[keep]]


def _stretches(*following: np.ndarray, same: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """First and last of stretches in which each of ``following`` goes up by one and each of ``same`` stays."""
    apart = np.zeros(max(len(following[0]) - 1, 0), bool)
    for x in following:
        apart |= x[1:] != x[:-1] + 1
    for x in same:
        apart |= x[1:] != x[:-1]
    cut = np.flatnonzero(apart)
    return (np.concatenate([[0], cut + 1]), np.append(cut, len(following[0]) - 1)) if len(following[0]) else (cut, cut)


def repeats(doc: np.ndarray, key: np.ndarray, place: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray, text: bytes) -> np.ndarray:
    """Which windows also start in a document with a lesser id; ``start`` and ``end`` are their bytes in ``text``."""
    hit = np.zeros(len(doc), bool)
    order = np.lexsort((doc, code))
    a, b = runs_of(code[order])
    leader = np.empty(len(order), np.int64)
    leader[order] = np.repeat(order[a], b - a)
    late = np.flatnonzero(doc > doc[leader])
    if not len(late):
        return hit
    # Neighbouring windows whose leaders are neighbours too are compared as one stretch.
    firsts, lasts = _stretches(late, leader[late], place[late], same=(key[late],))
    wrong = [k for k, (p, q) in enumerate(zip(late[firsts].tolist(), late[lasts].tolist())) if text[start[p] : end[q]] != text[start[leader[p]] : end[leader[q]]]]
    hit[late] = True
    if wrong:  # equal hashes of unequal windows, or leaders that lie apart: those groups are settled by their bytes
        codes = np.unique(np.concatenate([code[late[firsts[k] : lasts[k] + 1]] for k in wrong]))
        least: dict[bytes, int] = {}
        odd = np.flatnonzero(np.isin(code, codes)).tolist()
        for i in odd:
            w = text[start[i] : end[i]]
            least[w] = min(least.get(w, LAST), int(doc[i]))
        for i in odd:
            hit[i] = doc[i] > least[text[start[i] : end[i]]]
    return hit


def report(doc: np.ndarray, key: np.ndarray, place: np.ndarray, window: int) -> pa.RecordBatch | None:
    """Rows ``FOUND`` of repeated windows: words as intervals by document."""
    if not len(doc):
        return None
    order = np.lexsort((place, key, doc))
    doc, key, place = doc[order], key[order], place[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] > place[:-1] + window)])
    x = np.flatnonzero(fresh)
    y = np.append(x[1:], len(doc)) - 1
    both = np.stack([place[x], place[y] + window], axis=1).astype("<i8")
    doc, key = doc[x], key[x]
    cuts = sorted({*runs_of(doc)[0].tolist(), *runs_of(key)[0].tolist()})
    parts = [both[p:q].tobytes() for p, q in zip(cuts, [*cuts[1:], len(doc)])]
    return pa.RecordBatch.from_arrays([pa.array(doc[cuts], pa.int64(), mask=doc[cuts] == LAST), pa.array(key[cuts], pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "text_key", "intervals"])


def pack_windows(buckets: int, parts: int, window: int, hot: np.ndarray):
    """Packed super-k-mers by bucket; rows of bucket -1 hold what repeats within the piece of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches, "text", MAP_BYTES):
            words = Words(*bytes_of(batch, "text"))
            n = len(words) - window + 1
            if n <= 0:
                continue
            text, at = words.joined()
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            code = shingle_hashes(words.hash, window)
            whole = np.flatnonzero(words.text[:n] == words.text[window - 1 :])
            row = words.text[whole]
            place = whole - words.first[row]
            hit = repeats(ids[row], keys[row], place, code[whole], at[whole], at[whole + window] - 1, text)
            out: list[list] = [[], [], []]
            if (rows := report(ids[row][hit], keys[row][hit], place[hit], window)) is not None:
                with pa.BufferOutputStream() as sink:
                    with pa.ipc.new_stream(sink, rows.schema) as writer:
                        writer.write_batch(rows)
                    out[0].append(int(code[0] % np.uint64(parts)))
                    out[1].append(-1)
                    out[2].append(sink.getvalue().to_pybytes())
            keep = np.ones(n, bool)
            keep[whole[hit]] = False
            a, b, least = super_kmers(words, window, keep)
            if len(hot):
                alone = np.isin(least, hot)
                sizes = np.where(alone, b - a, 1)
                nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                alone, a, b, least = (np.repeat(x, sizes) for x in (alone, a, b, least))
                a = a + nth
                b = np.where(alone, a + 1, b)
                least = np.where(alone, code[a], least)
            bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            a, b, bucket = a[order], b[order], bucket[order]
            row = words.text[a]
            docs, own = ids[row], keys[row]
            place = a - words.first[row]
            begin, end = at[a], at[b + window - 1]
            begins, ends = begin.tolist(), end.tolist()
            for x, y in zip(*runs_of(bucket)):
                out[0].append(int(bucket[x]) % parts)
                out[1].append(int(bucket[x]))
                out[2].append(_pack([docs[x:y], own[x:y], place[x:y], (end - begin)[x:y]], b"".join([text[p:q] for p, q in zip(begins[x:y], ends[x:y])])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["part", "bucket", "payload"])

    return run


def hot_minimisers(rows: DataFrame, size: int, window: int) -> np.ndarray:
    """Sorted minimisers whose super-k-mers would be more than a bucket, by a sample of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches, "text", MAP_BYTES):
            words = Words(*bytes_of(batch, "text"))
            a, b, least = super_kmers(words, window)
            if len(a):
                found, at = np.unique(least, return_inverse=True)
                sizes = np.bincount(at, weights=words.end[b + window - 2] - words.start[a])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at), pa.int64()), pa.array(sizes)], ["least", "n", "size"])

    share = min(1.0, max(SAMPLE_BYTES / max(size, 1), SAMPLE_SHARE))
    most = max(BUCKET_BYTES, 3 * size / HOT)
    seen = rows.select("text").sample(share, seed=11).mapInArrow(run, "least long, n long, size double").groupBy("least").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    # The sizes add up to about three times the corpus, so no more than HOT of them are that large.
    found = seen.where((F.col("n") >= 4) & (F.col("size") > most * share)).select("least").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


class Bucket:
    """Windows of a bucket, as far as they have come."""

    def __init__(self, window: int):
        self.window, self.payloads, self.size, self.most = window, [], 0, HELD_BYTES

    def add(self, payload: bytes) -> pa.RecordBatch | None:
        rows, text = _unpack(payload)
        self.payloads.append((rows, text))
        self.size += rows.nbytes + len(text)
        return self.settle(on=True) if self.size > self.most else None

    def settle(self, on: bool = False) -> pa.RecordBatch | None:
        """Reports what repeats an earlier document; with ``on`` the windows that don't are held."""
        window = self.window
        rows, text = np.concatenate([r for r, _ in self.payloads], axis=1), b"".join([t for _, t in self.payloads])
        self.payloads, self.size, self.most = [], 0, HELD_BYTES
        words = Words(np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(rows[3])]))
        n = len(words) - window + 1
        whole = np.flatnonzero(words.text[:n] == words.text[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(whole):
            return None
        row = words.text[whole]
        doc, key, place = rows[0][row], rows[1][row], rows[2][row] + whole - words.first[row]
        start, end = words.start[whole], words.end[whole + window - 1]
        hit = repeats(doc, key, place, shingle_hashes(words.hash, window)[whole], start, end, text)
        if on:
            left = np.flatnonzero(~hit)
            p, q = _stretches(left, place[left], same=(row[left],))
            p, q = left[p], left[q]
            held = b"".join([text[x:y] + b" " for x, y in zip(start[p].tolist(), end[q].tolist())])
            self.payloads = [(np.stack([doc[p], key[p], place[p], end[q] - start[p] + 1]), held)]
            self.size = 32 * len(p) + len(held)
            self.most = max(HELD_BYTES, 2 * self.size)  # a bucket of different windows is settled ever more rarely
        return report(doc[hit], key[hit], place[hit], window)


def find_repeats(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, Bucket(window)
        for batch in batches:
            for b, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                if b < 0:
                    yield from pa.ipc.open_stream(payload.as_buffer())
                    continue
                if b != number and held.payloads and (out := held.settle()) is not None:
                    yield out
                number = b
                if (out := held.add(payload.as_py())) is not None:
                    yield out
        if held.payloads and (out := held.settle()) is not None:
            yield out

    return run


def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_text_size(batches, "text"):
        rows: list[tuple] = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("intervals").to_pylist()):
            words = (text or "").encode().split()  # bytes.split() cuts at exactly these six characters
            total = len(words)
            if found:
                gone = np.zeros(total + 1, np.int64)
                spans = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                np.add.at(gone, spans[:, 0], 1)
                np.add.at(gone, spans[:, 1], -1)
                keep = np.cumsum(gone[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist()) if k]
            kept = b" ".join(words)
            rows.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        n, gone, sha, kept = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word counts, and the kept words joined by single spaces (``kept``) with their digest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Only rows that share an id need their text's hash to be told apart.
    single = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = rows.withColumn("text_key", F.lit(0).cast("long") if single else F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = hot_minimisers(rows, size, window)
    size *= 3
    # About 24 MB a task, until there are so many tasks that they had better grow.
    parts = max(shuffle_width(spark), min(size // (24 << 20), 10_000), size // (256 << 20))
    buckets = min(max(4 * parts, size // BUCKET_BYTES), (1 << 31) - 1)
    packed = rows.mapInArrow(pack_windows(buckets, parts, window, hot), PACKED)
    found = packed.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket").mapInArrow(find_repeats(window), FOUND)
    found = Scratch(spark, "repeats").save(found, "found")
    gone = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list("intervals").alias("intervals"))
    # Texts stream past their task's intervals unsorted.
    joined = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", "text", "intervals").mapInArrow(take_out, RESULT + ", kept string")
