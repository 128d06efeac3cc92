"""Language-model scores of all texts from an n-gram trie in Elias-Fano levels.

Tokens are words, A-Z lower-cased, and one end mark a text, which is also what
stands before its first word.  The model is interpolated absolute discounting:

    P_k(w | c) = max(n(cw) - D, 0) / n(c) + D t(c) / n(c) P_{k-1}(w | c less its first word)

with ``n`` the counts of training texts and ``t(c)`` the number of different words
after ``c``; a context never seen passes on to the shorter one.  ``P_1`` is the
base, the word counts with a half added, which keeps room for unknown words.

1. Texts become chunks of about ``CHUNK_TOKENS`` tokens: a dictionary of word
   hashes and the tokens as places in it.  This table is written.
2. A chunk sends each different n-gram once, with its count in training texts,
   to the shard of its context: contexts are dealt by ranges of their hash.
   Contexts that hold much of all n-grams are dealt in parts, by the word
   that follows, so no shard depends on one of them.
3. A shard adds up the counts and builds one level of the trie: sorted contexts,
   pointers to where their words begin, running counts and the words after each,
   all Elias-Fano sequences, and the discounted probabilities and back-off
   weights as bytes on a scale of logarithms.  The level is mapped into memory
   and answers all chunks: the context's place, then the successor search for
   ``place * words + word`` within its pointers.
4. Answers come back in the order they were asked, so they need no keys; a
   chunk puts them together, from the base upwards, and sums its texts.

The n-grams travel once, for training and for scoring.  A level holds every
n-gram of the training texts, so what is gathered grows with them.  Contexts
are told apart by 56 bits of their hash and the words after a context by 24: of
``t`` words after one context, about ``t / 2^25`` of each share them with another.

Defined results: null text is empty text, its end mark alone; a null id is held
out or not by the word ``null``; repeated rows are scored alike, and each counts
in training; without training texts every token is unknown with probability 1;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_text_size, bytes_of, give_back
from .elias_fano import EliasFano
from .scratch import Scratch, shuffle_width
from .words import Words, lower_ascii, mix, runs_of

_U = np.uint64
CHUNK_TOKENS = 1 << 21
#: Tokens for which there is a shard an order, and most shards.
SHARD_TOKENS, SHARDS = 3 << 18, 1 << 14
#: Bits of a word's hash that tell the words after a context apart, and those of a context's hash.
WORD_BITS = 24
CONTEXT_MASK = _U(((1 << 56) - 1) << 8)
#: Contexts before a greater share of tokens than one in so many are watched.
WATCHED = 4096
#: A byte is a negative logarithm in these parts of a decade; 0 is absent.
STEPS = 28.0
END = _U(0x5BD1E9955BD1E995)
_BASE = _U(0x9E3779B97F4A7C15)
CHUNK = "chunk long, ids array<long>, known array<boolean>, sizes array<int>, words binary, tokens binary, n long, heavy array<struct<order:int,context:long,tokens:long>>"
ASKED = "order int, shard int, chunk long, asked binary"
ANSWER = "order int, shard int, chunk long, answer binary, tokens long, words long, parts array<struct<cell:long,n:long,t:long>>, level binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed planes of bytes, the upper ones of which repeat."""
    head = np.array([len(arrays), *map(len, arrays)], np.uint64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.uint64, len(kinds), 8).astype(np.int64).tolist()
    at, out = 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, sizes):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def to_code(p: np.ndarray) -> np.ndarray:
    return (1 + np.rint(-np.log10(p) * STEPS)).clip(1, 255).astype(np.uint8)


#: Probability of each byte.
VALUE = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


def order_of(values: np.ndarray) -> np.ndarray:
    """Order of numbers, by a plain sort of their upper bits with their places."""
    n = len(values)
    place = max(n - 1, 0).bit_length()
    low = values.min() if n else _U(0)
    spare = max(0, int(values.max() - low).bit_length() + place - 64) if n else 0
    key = np.sort((values - low >> _U(spare)) << _U(place) | np.arange(n, dtype=np.uint64))
    order = (key & _U((1 << place) - 1)).astype(np.int64)
    if spare:
        found = values[order]
        wrong = np.flatnonzero(found[1:] < found[:-1])
        if len(wrong):  # a few share all upper bits
            return order[np.argsort(found, kind="stable")]
    return order


def order_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order of pairs of small numbers, in one number each where they fit."""
    if not len(a):
        return np.zeros(0, np.int64)
    width = int(b.max()).bit_length()
    if int(a.max()).bit_length() + width > 63:
        return np.lexsort((b, a))
    return order_of(a.astype(np.uint64) << _U(width) | b.astype(np.uint64))


class Grams:
    """Different n-grams of one order in a chunk.

    ``of``: of each token, its n-gram; ``context`` and ``word``: of each n-gram, by place in the order below and in the dictionary;
    ``first``: of each n-gram, a token; ``hash``: of each n-gram; ``key``: of each context, what names it in shards.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, context_hash: np.ndarray, word_hash: np.ndarray):
        order = order_of_pairs(contexts, words)
        a, b = runs_of((contexts << 32 | words)[order])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(a)), b - a)
        self.first = order[a]
        self.context, self.word = contexts[self.first], words[self.first]
        self.key = context_hash & CONTEXT_MASK
        self.hash = mix(context_hash[self.context] * _BASE + word_hash[self.word])


class Contexts:
    """Of each token the n-gram that ends before it, and the hash of each such n-gram; ``grams`` are the longer ones."""

    def __init__(self, tokens: np.ndarray, start: np.ndarray, word_hash: np.ndarray, of: np.ndarray, hashes: np.ndarray, at_start: int):
        self.tokens, self.start, self.word_hash, self.hash, self.at_start = tokens, start, word_hash, hashes, at_start
        self.of = np.empty_like(of)
        self.of[1:] = of[:-1]
        self.of[start] = at_start

    @cached_property
    def grams(self) -> Grams:
        return Grams(self.of, self.tokens, self.hash, self.word_hash)

    def longer(self) -> Contexts:
        # What stands before a text is end marks throughout.
        start = mix(self.hash[self.at_start : self.at_start + 1] * _BASE + END)
        return Contexts(self.tokens, self.start, self.word_hash, self.grams.of, np.append(self.grams.hash, start), len(self.grams.hash))


def contexts_of(tokens: np.ndarray, sizes: np.ndarray, word_hash: np.ndarray, order: int) -> Iterator[tuple[int, Contexts]]:
    """Contexts of orders 2 and up."""
    found = Contexts(tokens, np.cumsum(sizes) - sizes, word_hash, tokens, word_hash, int(np.flatnonzero(word_hash == END)[0]))
    for k in range(2, order + 1):
        yield k, found
        if k < order:
            found = found.longer()


class Cells:
    """What a chunk asks of an order: contexts, or parts of hot ones, in the order of their hash, and the words after each."""

    def __init__(self, grams: Grams, word_hash: np.ndarray, hot: tuple[np.ndarray, np.ndarray], shards: int, word_bits: int):
        word = (word_hash >> _U(64 - word_bits)).astype(np.uint32)[grams.word]
        known, of = grams.key, grams.context
        places = np.searchsorted(hot[0], known)
        watched = np.flatnonzero(hot[0][np.minimum(places, len(hot[0]) - 1)] == known) if len(hot[0]) else np.zeros(0, np.int64)
        if len(watched):  # each part is a cell after those of whole contexts
            here = np.flatnonzero(np.isin(of, watched))
            parts, mine = np.unique(np.stack([of[here], word[here] % hot[1][places[of[here]]]]), axis=1, return_inverse=True)
            of = of.copy()
            of[here] = len(known) + mine.ravel()
            known = np.append(known, part_hash(known[parts[0]], parts[1]))
        rank = np.empty(len(known), np.int64)
        sorted_ = order_of(known)
        rank[sorted_] = np.arange(len(known))
        self.order = order_of_pairs(rank[of], word)
        cell = rank[of][self.order]
        self.word = word[self.order]
        self.first, end = runs_of(cell)
        self.sizes = end - self.first
        self.hash = known[sorted_[cell[self.first]]]
        self.of = np.repeat(np.arange(len(self.first)), self.sizes)
        shard = ((self.hash >> _U(32)) * _U(shards)) >> _U(32)
        self.bounds = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        self.gram_bounds = np.append(self.first, len(self.word))[self.bounds]


def part_hash(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    return mix(context ^ mix(part.astype(np.uint64) + _U(1))) & CONTEXT_MASK


class Level:
    """One shard of one order, read in place from a buffer, such as a memory-mapped file."""

    @staticmethod
    def build(cell: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> bytes:
        """From different n-grams sorted by the hash of their context and the word."""
        a, b = runs_of(cell)
        sizes = b - a
        running = np.append(0, np.cumsum(count))
        total = running[b] - running[a]
        words = np.unique(word)
        place = np.repeat(np.arange(len(a)), sizes).astype(np.uint64) * _U(len(words)) + np.searchsorted(words, word).astype(np.uint64)
        parts = [EliasFano.of(x).to_bytes() for x in (cell[a], np.append(a, len(cell)), running[np.append(a, len(cell))], words, place)]
        codes = to_code((count - discount) / np.repeat(total, sizes))
        weights = to_code(discount * sizes / total)
        return b"".join(parts) + np.array([len(codes), len(weights)], np.uint64).tobytes() + codes.tobytes() + weights.tobytes()

    def __init__(self, buffer: memoryview):
        at, parts = 0, []
        for _ in range(5):
            part, at = EliasFano.view(buffer, at)
            parts.append(part)
        self.cells, self.pointers, self.running, self.words, self.places = parts
        n, m = (int(x) for x in np.frombuffer(buffer, np.uint64, 2, at))
        self.codes, self.weights = np.frombuffer(buffer, np.uint8, n, at + 16), np.frombuffer(buffer, np.uint8, m, at + 16 + n)

    def contexts(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place (-1: unknown) and back-off byte of each context."""
        place = self.cells.find(cell)
        return place, np.where(place >= 0, self.weights[np.maximum(place, 0)], 0).astype(np.uint8) if len(self.weights) else np.zeros(len(cell), np.uint8)

    def counts(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each context and number of different words after it."""
        known = np.flatnonzero(place >= 0)
        n, t = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for out, found in ((n, self.running), (t, self.pointers)):
            out[known] = found.access(place[known] + 1) - found.access(place[known])
        return n, t

    def after(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Byte of each word after the context of this place; 0 if it was not seen there."""
        out = np.zeros(len(word), np.uint8)
        words, of = np.unique(word, return_inverse=True)
        found = self.words.find(words)[of]
        on = np.flatnonzero((place >= 0) & (found >= 0))
        at = self.places.find(place[on].astype(np.uint64) * _U(len(self.words)) + found[on].astype(np.uint64))
        out[on[at >= 0]] = self.codes[at[at >= 0]]
        return out


def mapped(data: bytes) -> memoryview:
    """The bytes in a memory map of their own, outside the heap."""
    area = mmap.mmap(-1, max(len(data), 1))
    area.write(data)
    return memoryview(area)


def crc_split(folds: int, fold: int) -> Callable[[int | None], bool]:
    """Whether an id belongs to the training texts: the CRC-32 of its digits leaves another remainder than ``fold``."""
    return lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % folds != fold


def chunk_row(at: int, ids: list, parts: list[np.ndarray], order: int, trained: Callable[[int | None], bool]) -> list[list]:
    """Columns of ``CHUNK`` with one row, from the word hashes of each text."""
    hashes = np.concatenate(parts)
    words, tokens, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = np.argsort(-counts, kind="stable")
    back = np.empty_like(rank)
    back[rank] = np.arange(len(rank))
    words, tokens = words[rank], back[tokens]  # frequent words have small places
    sizes = np.array([len(p) for p in parts])
    heavy = []
    for k, contexts in contexts_of(tokens, sizes, words, order):
        n = np.bincount(contexts.of, minlength=len(contexts.hash))
        heavy += [{"order": k, "context": int((contexts.hash[c] & CONTEXT_MASK).view(np.int64)), "tokens": int(n[c])} for c in np.flatnonzero(n * WATCHED >= max(len(tokens), WATCHED * 16)).tolist()]
    return [[at], [ids], [[trained(i) for i in ids]], [sizes.tolist()], [pack(words)], [pack(tokens.astype(np.uint32))], [len(tokens)], [heavy]]


def to_chunks(rows: DataFrame, order: int, trained: Callable[[int | None], bool]) -> DataFrame:
    """``CHUNK`` rows of ``(doc_id, text)``."""

    names = "chunk ids known sizes words tokens n heavy".split()
    found = pa.struct([("order", pa.int32()), ("context", pa.int64()), ("tokens", pa.int64())])
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.list_(found)]

    def close(at: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(chunk_row(at, ids, parts, order, trained), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in by_text_size(batches, "text"):
            raw, bounds = bytes_of(batch, "text")
            words = Words(lower_ascii(raw), bounds)
            ids += batch.column("doc_id").to_pylist()
            parts += [np.append(words.hash[x:y], END) for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            held += len(words) + batch.num_rows
            if held >= CHUNK_TOKENS:
                yield close(at, ids, parts)
                at, ids, parts, held = at + 1, [], [], 0
                give_back()
        if ids:
            yield close(at, ids, parts)

    return rows.mapInArrow(run, CHUNK)


def _read_chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, texts' sizes and word hashes."""
    return unpack(row["tokens"], np.uint32)[0].astype(np.int64), np.array(row["sizes"], np.int64), unpack(row["words"], np.uint64)[0]


Hot = dict[int, tuple[np.ndarray, np.ndarray]]


def hot_contexts(chunks: DataFrame, order: int, shards: int, total: int) -> Hot:
    """By order: hashes of contexts with more than half a shard's share of all tokens, and their numbers of parts; at most ``WATCHED`` an order."""
    each = chunks.select(F.explode("heavy").alias("h")).groupBy("h.order", "h.context").agg(F.sum("h.tokens").alias("tokens"))
    found = each.where(F.col("tokens") > max(2 * total // WATCHED, total // (2 * shards))).collect()
    out: Hot = {}
    for k in range(2, order + 1):
        own = sorted((np.int64(r["context"]).view(np.uint64), -(-4 * r["tokens"] * shards // total)) for r in found if r["order"] == k)
        out[k] = np.array([c for c, _ in own], np.uint64), np.array([m for _, m in own], np.uint32)
    return out


def hot_cells(hot: Hot) -> dict[int, np.ndarray]:
    """By order: hashes of all parts of hot contexts."""
    return {k: np.sort(np.concatenate([part_hash(np.full(m, c, np.uint64), np.arange(m)) for c, m in zip(contexts, parts.tolist())])) if len(contexts) else np.zeros(0, np.uint64) for k, (contexts, parts) in hot.items()}


def asked_rows(row: dict, order: int, shards: int, hot: Hot, word_bits: int) -> Iterator[list[tuple]]:
    """Rows of ``ASKED`` of a chunk, by order."""
    tokens, sizes, words = _read_chunk(row)
    train = np.repeat(np.array(row["known"], bool), sizes)
    for k, contexts in contexts_of(tokens, sizes, words, order):
        grams = contexts.grams
        cells = Cells(grams, words, hot[k], shards, word_bits)
        counts = np.bincount(grams.of[train], minlength=len(grams.word)).astype(np.uint32)[cells.order]
        found = []
        for s in np.flatnonzero(np.diff(cells.bounds)).tolist():
            (a, b), (x, y) = cells.bounds[s : s + 2], cells.gram_bounds[s : s + 2]
            found.append((k, s, row["chunk"], pack(cells.hash[a:b], cells.sizes[a:b].astype(np.uint32), cells.word[x:y], counts[x:y])))
        yield found


def ask(chunks: DataFrame, order: int, shards: int, hot: Hot, word_bits: int) -> DataFrame:
    """``ASKED``: the n-grams of each chunk by shard, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for found in asked_rows(row, order, shards, hot, word_bits):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["order", "shard", "chunk", "asked"])
                give_back()

    return chunks.mapInArrow(run, ASKED)


def answer_rows(order: int, shard: int, chunks: list[int], asked: list[bytes], discount: float, hot: np.ndarray, keep_level: bool) -> list[tuple]:
    """Rows of ``ANSWER`` of one shard."""
    asked = [unpack(x, np.uint64, np.uint32, np.uint32, np.uint32) for x in asked]
    hashes = np.concatenate([a[0] for a in asked])
    by = order_of(hashes)
    a, b = runs_of(hashes[by])
    cells, of = hashes[by[a]], np.empty(len(by), np.int64)
    of[by] = np.repeat(np.arange(len(a)), b - a)
    # Of every n-gram asked: its cell, its word and its place among the different ones.
    cell, word = np.repeat(of, np.concatenate([a[1] for a in asked])), np.concatenate([a[2] for a in asked])
    by = order_of_pairs(cell, word)
    a, b = runs_of((cell << 32 | word)[by])
    gram = np.empty(len(by), np.int64)
    gram[by] = np.repeat(np.arange(len(a)), b - a)
    count = np.add.reduceat(np.concatenate([a[3] for a in asked]).astype(np.int64)[by], a)
    cell, word = cell[by[a]], word[by[a]]
    seen = count > 0
    data = Level.build(cells[cell[seen]], word[seen], count[seen], discount)
    level = Level(mapped(data))
    place, weight = level.contexts(cells)
    codes = level.after(place[cell], word)
    mine = np.isin(cells, hot) if len(hot) else np.zeros(len(cells), bool)
    parts = [{"cell": c, "n": n, "t": t} for c, n, t in zip(cells[mine].view(np.int64).tolist(), *(x.tolist() for x in level.counts(place[mine])))]
    n = level.counts(place)[0] if order == 2 else np.zeros(0, np.int64)
    rows = [(order, shard, -1, None, int(count.sum()), int((place[~mine] >= 0).sum()), parts, data if keep_level else None)]
    ends = np.cumsum([(len(x[0]), len(x[2])) for x in asked], axis=0)
    for chunk, x, (c, g) in zip(chunks, asked, ends.tolist()):
        p, q = of[c - len(x[0]) : c], gram[g - len(x[2]) : g]
        counts = n[p].astype(np.uint64) if order == 2 else n.astype(np.uint64)
        # Only the chunk knows all parts of a hot context, so it gets exact counts and rounds itself.
        exact = count[q[mine[cell[q]]]] if len(parts) else np.zeros(0, np.int64)
        rows.append((order, shard, chunk, pack(counts, weight[p], codes[q], exact.astype(np.uint64)), 0, 0, None, None))
    return rows


def answer(asked: DataFrame, discount: float, hot: dict[int, np.ndarray], tasks: int, keep_levels: bool) -> DataFrame:
    """``ANSWER``: one row a shard and chunk, in the order asked, and one row a shard (chunk -1) with what it holds."""
    part = pa.struct([("cell", pa.int64()), ("n", pa.int64()), ("t", pa.int64())])
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(part), pa.binary()]
    names = [c.split()[0] for c in "order int, shard int, chunk long, answer binary, tokens long, words long, parts array, level binary".split(", ")]

    def run(table: pa.Table) -> pa.Table:
        order, shard = table.column("order")[0].as_py(), table.column("shard")[0].as_py()
        rows = answer_rows(order, shard, table.column("chunk").to_pylist(), [x.as_py() for x in table.column("asked")], discount, hot[order], keep_levels)
        give_back()
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return asked.repartition(tasks, "order", "shard").groupBy("order", "shard").applyInArrow(run, ANSWER)


def put_together(row: dict, answers: list[dict], order: int, hot: Hot, wholes: dict[int, dict[int, tuple[int, int]]], shards: int, total: int, vocabulary: int, discount: float, word_bits: int) -> dict[str, np.ndarray]:
    """Sums of the chunk's texts from what the shards say."""
    tokens, sizes, words = _read_chunk(row)
    known = {(a["order"], a["shard"]): a["answer"] for a in answers}
    base = lower = counts = None
    of = tokens
    for k, contexts in contexts_of(tokens, sizes, words, order):
        grams = contexts.grams
        cells = Cells(grams, words, hot[k], shards, word_bits)
        found = [unpack(known[k, s], np.uint64, np.uint8, np.uint8, np.uint64) for s in np.flatnonzero(np.diff(cells.bounds)).tolist()]
        n, weight, codes, exact = (np.concatenate(x) for x in zip(*found))
        weight, p = VALUE[weight], VALUE[codes]
        seen = weight > 0
        context = grams.context[cells.order[cells.first]]
        # The parts of a hot context have counts of their own; here are the numbers of the whole.
        split = np.isin(grams.key[context], hot[k][0]) if len(hot[k][0]) else np.zeros(len(context), bool)
        whole = np.ones((len(context), 2))
        for c in np.flatnonzero(split).tolist():
            whole[c] = wholes[k][int(grams.key[context[c]])]
        seen[split] = whole[split, 0] > 0
        on = split & seen
        weight[on] = VALUE[to_code(discount * whole[on, 1] / whole[on, 0])]
        if k == 2:
            n[split] = whole[split, 0].astype(np.uint64)
        inside = np.flatnonzero(split[cells.of])
        met = exact > 0
        p[inside] = 0.0
        p[inside[met]] = VALUE[to_code((exact[met] - discount) / whole[cells.of[inside[met]], 0])]
        if k == 2:
            counts = np.zeros(len(words), np.float64)
            counts[context] = n
            base = (counts + 0.5) / (total + 0.5 * (vocabulary + 1))
            lower = base
        smoothed = np.empty(len(grams.word))
        smoothed[cells.order] = p + np.where(seen, weight, 1.0)[cells.of] * lower[of[grams.first]][cells.order]
        lower, of = smoothed, grams.of
    start = np.cumsum(sizes) - sizes
    return {
        "doc_id": row["ids"], "held_out": [not k for k in row["known"]], "n_tokens": sizes, "n_known": np.add.reduceat((counts > 0)[tokens].astype(np.int64), start),
        "train_tokens": np.full(len(sizes), total), "base_score": np.add.reduceat(np.log10(base)[tokens], start), "score": np.add.reduceat(np.log10(lower)[of], start),
    }


def score_texts(docs: DataFrame, order: int = 3, discount: float = 0.75, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", word_bits: int = WORD_BITS, levels_to: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row a document.

    ``word_bits`` (up to 32) tell the words after a context apart.  ``levels_to`` names a folder for the trie: ``(order, shard, level)``, each level the buffer of a ``Level``.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scratch = Scratch(spark, "ngrams")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = scratch.save(to_chunks(rows, order, crc_split(folds, fold)), "chunks")
    tokens, pieces = chunks.agg(F.sum("n"), F.count("*")).first()
    if not tokens:
        return spark.createDataFrame([], kind)
    least = shuffle_width(spark)
    shards = int(min(SHARDS, max(least, -(-tokens // SHARD_TOKENS))))
    hot = hot_contexts(chunks, order, shards, tokens)
    answers = scratch.save(answer(ask(chunks, order, shards, hot, word_bits), discount, hot_cells(hot), shards * (order - 1), levels_to is not None), "answers")
    about = answers.where("chunk = -1")
    if levels_to:
        about.select("order", "shard", "level").write.mode("overwrite").parquet(levels_to)
    # A row a shard in all, and at most one for each part of a hot context.
    total, vocabulary = about.where("order = 2").agg(F.sum("tokens"), F.sum("words")).first()
    cells = {(r["order"], np.int64(r["cell"]).view(np.uint64).item()): (r["n"], r["t"]) for r in about.select("order", F.inline("parts")).collect()}
    wholes: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in hot}
    for k, (contexts, many) in hot.items():
        for c, m in zip(contexts, many.tolist()):
            numbers = [cells.get((k, x), (0, 0)) for x in part_hash(np.full(m, c, np.uint64), np.arange(m)).tolist()]
            n, t = (sum(x) for x in zip(*numbers))
            wholes[k][int(c)] = n, t
            vocabulary += int(k == 2 and n > 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        done = [put_together(row, right.to_pylist(), order, hot, wholes, shards, total, vocabulary, discount, word_bits) for row in left.to_pylist()]
        give_back()
        out = {c: np.concatenate([d[c] for d in done]) if c != "doc_id" else sum((d[c] for d in done), []) for c in names}
        return pa.table([pa.array(out[c], t) for c, t in zip(names, types)], names=names)

    names = [c.split()[0] for c in kind.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    texts = chunks.select("chunk", "ids", "known", "sizes", "words", "tokens")
    back = answers.where("chunk >= 0").select("order", "shard", "chunk", "answer")
    dealt = lambda df: df.repartition(max(least, pieces), "chunk").groupBy("chunk")
    return dealt(texts).cogroup(dealt(back)).applyInArrow(run, kind)
