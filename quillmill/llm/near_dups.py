"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

1. A shingle is five words (case and punctuation set aside); a shorter text is
   one shingle.  Its weight is its count times a factor from 1 (a shingle of all
   documents) to 2 (of at most one in ``RARE`` documents).  Frequencies are
   counted over all documents by slot of a hashed table of fixed width, so what
   tasks get is of one size at any scale; the load of rare shingles, which the
   slots share evenly, is taken off as the median slot.  What is left differs
   from the shingle's own frequency by the spread of that load, which is far
   under ``N / RARE`` and shrinks against it as the corpus grows.
2. Improved consistent weighted sampling draws ``HASHES`` samples a text; the
   chance that two texts draw alike is their weighted Jaccard similarity.
   Four samples in a row make a band key; 16 bands miss a pair of similarity
   0.8 with a chance of 0.0002.
3. Texts that share a band key are a bucket; buckets of the same texts are one.
   A bucket is compared in blocks of about ``BLOCK`` texts and ``BLOCK_BYTES``
   bytes: products of matrices give the weighted Jaccard similarity of all pairs
   of a block from the whole texts, and a spanning forest of the links and each
   text's best link leave it, never the pairs.  A bucket larger than two blocks
   is dealt to new ones round after round, its least text to each, until a round joins nothing; this
   joins the great classes.  What is still apart in it is settled exactly: two
   texts at the threshold share a feature of their prefixes (the rarest
   features, as far as the rest weighs under ``threshold`` of the text), so
   texts are compared by shared prefix feature; those whose feature is common
   are compared by all pairs of blocks of their bucket, without the pairs of
   blocks that are of one class already.
4. Classes are the connected components of links.  Exact copies are one node
   throughout, so copies cost a hash each.  A node is a text, named by its least
   id and its hash together, so rows that share an id and not the text are nodes
   of their own.  A document carries a verified link of its text, the best of
   those met: the partner's least id and the similarity.  In buckets of one block
   all pairs are met; in larger ones, pairs that are of one class already need
   not be, so a better partner may exist there.

Defined results: null text is empty text; texts without words match only their
exact copies; a class is named by its least id; of several classes with one
least id (rows that share an id and not the text) that of the least text hash
has the id, the others, and classes without an id, a negative number from the
hash; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_text_size, bytes_of
from .components import components
from .scratch import Scratch
from .sums import sum_arrays
from .words import Words, mix, runs_of, shingle_hashes

SHINGLE, HASHES, BAND = 5, 64, 4
SLOTS = 1 << 18
#: Texts, and bytes of text, compared with each other at once; buckets up to twice that are one block.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Shared shingles in one product of matrices.
COLUMNS = 1 << 10
#: One in so many documents is rare.
RARE = 1000
#: Shingles drawn from at once.
DRAW = 2048
_ID_BITS, _ID_MASK = 48, (1 << 48) - 1

_fold = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _fold[_c] = _c
_fold[65:91] = np.arange(97, 123)

_rng = np.random.default_rng(20100601)
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32).clip(1e-3)
_INV_R = (1 / _R).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16).clip(1e-6)).astype(np.float32)
_BETA = _rng.random(1 << 16).astype(np.float32)


def shingles(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle ids of each text in order, their counts, and the bounds of texts among them."""
    texts = len(bounds) - 1
    plain = _fold[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, np.int64)
    capital = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    plain[capital] += 32  # Latin-1 capitals
    words = Words(plain, bounds)
    n = len(words) - SHINGLE + 1
    found = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if n > 0:
        whole = np.flatnonzero(words.text[:n] == words.text[SHINGLE - 1 :])
        found, owner = shingle_hashes(words.hash, SHINGLE)[whole], words.text[whole]
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        one = [shingle_hashes(words.hash[words.first[t] : words.first[t + 1]], int(sizes[t]))[0] for t in short]
        found, owner = np.concatenate([found, np.array(one, np.uint64)]), np.concatenate([owner, short])
    if texts < 1 << 16:
        key = np.sort(owner.astype(np.uint64) << np.uint64(_ID_BITS) | found >> np.uint64(16))
        ids, owner = key & np.uint64(_ID_MASK), (key >> np.uint64(_ID_BITS)).astype(np.int64)
    else:
        ids = found >> np.uint64(16)
        order = np.lexsort((ids, owner))
        ids, owner = ids[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])])) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.append(fresh, len(ids)))
    return ids[fresh], counts, np.searchsorted(owner[fresh], np.arange(texts + 1))


def slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids) >> np.uint64(64 - int(math.log2(SLOTS)))).astype(np.int64)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by slot of their shingles, and the number of documents."""

    def tally(total: np.ndarray, batch: pa.RecordBatch) -> None:
        ids, _, _ = shingles(*bytes_of(batch, "text"))
        total[:SLOTS] += np.bincount(slots(ids), minlength=SLOTS)
        total[SLOTS] += batch.num_rows

    total = sum_arrays(rows.select("text"), SLOTS + 1, tally, "text")
    return total[:SLOTS], int(total[SLOTS])


def inverse_frequencies(counts: np.ndarray, docs: int) -> np.ndarray:
    """From 1 (in every document) to 2 (in one of ``RARE``, or of all if they are fewer), by share of documents.

    The plain logarithm would weigh what a large group of copies shares so much
    less than each copy's own words that near copies would fall apart.
    """
    own = np.clip(counts - np.median(counts), 0, docs)
    return (1 + np.minimum(1, np.log((docs + 1) / (own + 1)) / np.log(min(RARE, docs) + 2))).astype(np.float32)


def sample(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``HASHES`` consistent samples (as hashes of shingle and quantised weight) of one text."""
    if not len(ids):
        return np.zeros(HASHES, np.uint64)
    code = mix(ids)
    low, high = (code & np.uint64(0xFFFF)).astype(np.uint16), (code >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)
    steps = np.arange(HASHES, dtype=np.uint16)[:, None]
    best, chosen, level = np.full(HASHES, np.inf, np.float32), np.zeros(HASHES, np.int64), np.zeros(HASHES, np.float32)
    log_w = np.log(weights).astype(np.float32)
    lanes = np.arange(HASHES)
    for x in range(0, len(ids), DRAW):
        at = low[x : x + DRAW] + steps * (high[x : x + DRAW] | np.uint16(1)) ^ (steps * np.uint16(0x9E37))
        beta = _BETA[at]
        t = np.floor(log_w[x : x + DRAW] * _INV_R[at] + beta)
        a = _LOG_C[at] - _R[at] * (t - beta + np.float32(1))
        k = a.argmin(axis=1)
        value = a[lanes, k]
        better = value < best
        best[better], chosen[better], level[better] = value[better], k[better] + x, t[lanes, k][better]
    return mix(ids[chosen] ^ mix((level.astype(np.int64) + lanes * 1000003).view(np.uint64)))


def features_of(ids: np.ndarray, counts: np.ndarray, at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, code and weight of each feature; the nth occurrence of a shingle is a feature of its own."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    weights = idf[slots(ids)].astype(np.float64)
    times = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner, features, weights = np.repeat(owner, counts), np.repeat(ids, counts), np.repeat(weights, counts)
    return owner, np.where(times > 0, mix(features + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), features), weights


def prefixes(ids: np.ndarray, counts: np.ndarray, at: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Text and code of the features of each text's prefix.

    Features are in one order everywhere, the heaviest (rarest) first.  The
    shared weight of two texts at the threshold is at least ``threshold`` of
    either's, and what follows a prefix weighs less than that, so the prefixes
    of such texts share a feature.
    """
    owner, features, weights = features_of(ids, counts, at, idf)
    order = np.lexsort((features, -weights, owner))
    owner, features, weights = owner[order], features[order], weights[order]
    ends = np.cumsum(np.bincount(owner, weights=weights, minlength=len(at) - 1))
    total = np.diff(ends, prepend=0)
    rest = ends[owner] - np.cumsum(weights) + weights
    keep = rest >= threshold * total[owner] - 1e-6
    return owner[keep], features[keep]


def similarities(ids: np.ndarray, counts: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a block's texts.

    The sum of lesser weights is a product of feature vectors.
    """
    n = len(at) - 1
    owner, features, weights = features_of(ids, counts, at, idf)
    total = np.bincount(owner, weights=weights, minlength=n)
    order = np.argsort(features)
    owner, weights = owner[order], np.sqrt(weights[order])
    a, b = runs_of(features[order])
    shared = b - a > 1
    taken = np.repeat(shared, b - a)
    owner, weights, column = owner[taken], weights[taken], np.repeat(np.arange(shared.sum()), (b - a)[shared])
    both = np.zeros((n, n))
    for x in range(0, int(shared.sum()), COLUMNS):
        p, q = np.searchsorted(column, (x, x + COLUMNS))
        part = np.zeros((n, COLUMNS))
        part[owner[p:q], column[p:q] - x] = weights[p:q]
        both += part @ part.T
    rest = total[:, None] + total[None, :] - both
    return np.divide(both, rest, out=np.zeros_like(both), where=rest > 0)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    found, fresh = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if not fresh[root]:
            continue
        fresh[root], waiting = False, [root]
        while waiting:
            k = waiting.pop()
            near = np.flatnonzero(links[k] & fresh)
            fresh[near] = False
            found += [(k, x) for x in near.tolist()]
            waiting += near.tolist()
    return found


def kept_links(near: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Of a matrix of similarities: a spanning forest of the links and the best link of each row."""
    np.fill_diagonal(near, -1)
    best = near.argmax(axis=1)
    linked = np.flatnonzero(near[np.arange(len(near)), best] >= threshold)
    return sorted({(min(x, y), max(x, y)) for x, y in [*forest(near >= threshold), *zip(linked.tolist(), best[linked].tolist())]})


def signatures(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """Bytes and band keys of each row of ``(doc_id, text_key, text)``; no keys without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int] | None] = {}
        for batch in by_text_size(batches, "text"):
            ids, counts, at = shingles(*bytes_of(batch, "text"))
            weights = counts * idf[slots(ids)]
            bands = []
            for k, key in enumerate(batch.column("text_key").to_pylist()):
                if key not in seen:
                    if len(seen) > 5000:
                        seen.clear()
                    x, y = at[k], at[k + 1]
                    seen[key] = mix(shingle_hashes(sample(ids[x:y], weights[x:y]), BAND)[::BAND] + np.arange(HASHES // BAND, dtype=np.uint64)).view(np.int64).tolist() if y > x else None
                bands.append(seen[key])
            sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), sizes, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "size", "bands"])

    return rows.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key binary, size long, bands array<long>")


def verify(members: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links ``(a, b, similarity)`` within the blocks of ``members (band, block, node)``, by whole texts ``(node, text)``."""
    rows = texts.join(members.hint("shuffle_hash"), "node").select("band", "block", "node", "text").repartition("band", "block").sortWithinPartitions("band", "block")

    def links(nodes: list[bytes], parts: list[pa.Array]) -> pa.RecordBatch:
        block = pa.RecordBatch.from_arrays([pa.concat_arrays(parts)], ["text"])
        near = similarities(*shingles(*bytes_of(block, "text")), idf)
        found = [(*sorted((nodes[x], nodes[y])), near[x, y]) for x, y in kept_links(near, threshold)] if len(nodes) > 1 else []
        a, b, how = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(how, pa.float64())], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, parts = None, [], []
        for batch in batches:
            place = list(zip(batch.column("band").to_pylist(), batch.column("block").to_pylist()))
            ids = batch.column("node").to_pylist()
            cuts = [k for k in range(1, len(place)) if place[k] != place[k - 1]]
            for x, y in zip([0, *cuts], [*cuts, len(place)]):
                if x == y:
                    continue
                if place[x] != at and nodes:
                    yield links(nodes, parts)
                    nodes, parts = [], []
                at = place[x]
                nodes += ids[x:y]
                parts.append(batch.column("text").slice(x, y - x))
        if nodes:
            yield links(nodes, parts)

    return rows.mapInArrow(run, "a binary, b binary, similarity double")


def prefix_features(texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``(node, feature)`` of the prefixes of ``texts (node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches, "text"):
            owner, features = prefixes(*shingles(*bytes_of(batch, "text")), idf, threshold)
            nodes = batch.column("node").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(features.view(np.int64))], ["node", "feature"])

    return texts.select("node", "text").mapInArrow(run, "node binary, feature long")


def node_of(doc_id: Column, key: Column) -> Column:
    """25 bytes that sort by id, null ids last, and then by text hash."""
    flipped = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.coalesce(F.concat(F.lit("00"), flipped), F.lit("01" + "0" * 16))), key)


def hash_name(node: Column) -> Column:
    return -F.abs(F.xxhash64(node) / 2).cast("long") - 1


def name_of(node: Column) -> Column:
    """The id in a node, or a negative number for null."""
    digits = F.hex(F.substring(node, 2, 8))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", F.conv(digits, 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))).otherwise(hash_name(node))


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1).cast("long"))


def _fits(n: Column, size: Column) -> Column:
    """Whether so many texts of so many bytes are one block."""
    return (n <= 2 * BLOCK) & (size <= 2 * BLOCK_BYTES)


def block_pairs(members: DataFrame) -> DataFrame:
    """``(band, block, node)`` in which any two texts of a band of ``members (band, node, label, size)`` with different labels meet.

    A label with a block's number of texts has blocks of its own, which are
    not compared with each other; the texts of all others share blocks.
    """
    sizes = members.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sizes = sizes.join(sizes.groupBy("band").agg(F.count("*").alias("labels")).where("labels > 1"), "band")
    sizes = sizes.select("band", "label", "n", "size", (F.col("n") >= BLOCK).alias("own")).withColumn("class", F.when(F.col("own"), F.col("label")).otherwise(F.lit(bytearray())))
    classes = sizes.groupBy("band", "own", "class").agg(_blocks(F.sum("n"), F.sum("size")).alias("many"))
    blocks = classes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).select("band", F.struct("own", "class", "k").alias("x"))
    apart = (F.col("x") < F.col("y")) & ~(F.col("x.own") & F.col("y.own") & (F.col("x.class") == F.col("y.class")))
    alone = (F.col("x") == F.col("y")) & ~F.col("x.own")
    pairs = blocks.join(blocks.withColumnRenamed("x", "y"), "band").where(apart | alone)
    pairs = pairs.select("band", F.xxhash64("x", "y").alias("block"), F.explode(F.array_distinct(F.array("x", "y"))).alias("place"))
    placed = members.join(sizes.select("band", "label", "own", "class"), ["band", "label"]).join(classes, ["band", "own", "class"])
    placed = placed.select("band", "node", F.struct("own", "class", F.pmod(F.xxhash64("node"), F.col("many")).alias("k")).alias("place"))
    return placed.join(pairs, ["band", "place"]).select("band", "block", "node")


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, class_id, class_texts, link_id, similarity``: one row a document.

    ``class_texts`` counts the class's different texts; ``link_id`` and
    ``similarity`` are a verified link of the document's text to another text
    (the partner's least id), the best of those met; null without one.
    """
    scratch = Scratch(docs.sparkSession, "near-dups")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    idf = inverse_frequencies(*document_frequencies(rows))
    signed = scratch.save(signatures(rows, idf), "signed")
    nodes = scratch.save(signed.groupBy("text_key").agg(node_of(F.min("doc_id"), F.col("text_key")).alias("node"), F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    spread = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    buckets = buckets.groupBy("least", "most", "all", "n", "bytes").agg(F.min("band").alias("band"))
    many = F.when(_fits(F.col("n"), F.col("bytes")), 1).otherwise(_blocks(F.col("n"), F.col("bytes")))
    met = scratch.save(spread.join(buckets.select("band", "least", many.cast("long").alias("many")), "band"), "met")
    # Nodes are the small side of every task, so texts stream past them unsorted; a text comes from the rows of its least id.
    active = scratch.save(met.select("node").distinct().join(nodes.select("node", "text_key", "least_id"), "node"), "active").withColumnsRenamed({"text_key": "_key", "least_id": "_id"})
    texts = rows.join(active.hint("shuffle_hash"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = scratch.save(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    def blocks(members: DataFrame, k: int) -> DataFrame:
        """Each text's block; the least text of a bucket, most often the first of its copies, is in all of them."""
        own = F.pmod(F.xxhash64("node", F.lit(k)), F.col("many"))
        return members.select("band", "node", F.explode(F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).otherwise(F.array(own))).alias("block"))

    links = scratch.save(verify(blocks(met, 0), texts, idf, threshold), "links-0")
    labels = components(links, scratch, "labels-0")
    wide = met.where("many > 1")
    k = 0

    def joined(found: DataFrame, name: str) -> bool:
        """Adds the links between different labels; whether there are any."""
        nonlocal links, labels
        lined = found.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        fresh = scratch.save(lined.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "similarity"), f"fresh-{name}")
        if fresh.isEmpty():
            return False
        links = links.unionAll(fresh)
        labels = components(links, scratch, f"labels-{name}")
        return True

    while not wide.isEmpty():
        k += 1
        named = wide.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = named.groupBy("band").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("band")
        wide = scratch.save(named.join(mixed, "band").select("band", "node", "size", "least", "many", "label"), f"wide-{k}")
        found = scratch.save(verify(blocks(wide, k), texts, idf, threshold), f"links-{k}")
        if not joined(found, str(k)):
            break
        wide = wide.drop("label")
    if k and not wide.isEmpty():
        waiting = scratch.save(wide.select("node", "label", "size").distinct(), "waiting")
        features = scratch.save(prefix_features(texts.join(waiting.hint("shuffle_hash"), "node", "left_semi"), idf, threshold), "features")
        shared = features.join(waiting.hint("shuffle_hash"), "node").groupBy("feature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
        shared = scratch.save(shared.where("low < high"), "shared")
        fits = _fits(F.col("n"), F.col("bytes"))
        narrow = shared.where(fits).groupBy("least", "most", "all", "n").agg(F.min("feature").alias("feature")).select("feature")
        members = features.join(narrow, "feature").select(F.col("feature").alias("band"), F.lit(0).alias("block"), "node")
        joined(scratch.save(verify(members, texts, idf, threshold), "links-narrow"), "narrow")
        rest = features.join(shared.where(~fits).select("feature"), "feature", "left_semi").select("node").distinct()
        rest = wide.drop("label").join(rest, "node", "left_semi").join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
        rest = scratch.save(rest, "rest")
        if not rest.isEmpty():
            joined(scratch.save(verify(block_pairs(rest), texts, idf, threshold), "links-pairs"), "pairs")
        for name in ("waiting", "features", "shared", "rest", "links-narrow", "links-pairs"):
            scratch.drop(name)
    for name in ("met", "active", "texts", *(f"wide-{j + 1}" for j in range(k)), *(f"links-{j + 1}" for j in range(k))):
        scratch.drop(name)
    partner = lambda x, y: links.select(F.col(x).alias("node"), F.struct("similarity", F.bitwise_not(name_of(F.col(y))).alias("other")).alias("link"))
    best = partner("a", "b").unionAll(partner("b", "a")).groupBy("node").agg(F.max("link").alias("link"))
    where = nodes.select("text_key", "node").join(labels, "node", "left").join(best, "node", "left")
    where = where.select("text_key", F.coalesce("label", "node").alias("label"), F.bitwise_not("link.other").alias("link_id"), F.col("link.similarity").alias("similarity"))
    sizes = where.groupBy("label").agg(F.count("*").alias("class_texts")).withColumn("class_id", name_of(F.col("label")))
    # Classes of one least id: only the first has its name.
    shared = sizes.groupBy("class_id").agg(F.count("*").alias("many"), F.min("label").alias("first")).where("many > 1").select("class_id", "first")
    sizes = sizes.join(shared, "class_id", "left").select("label", "class_texts", F.when(F.col("label") != F.col("first"), hash_name(F.col("label"))).otherwise(F.col("class_id")).alias("class_id"))
    return signed.select("doc_id", "text_key").join(where.join(sizes, "label"), "text_key").select("doc_id", "text_key", "class_id", "class_texts", "link_id", "similarity")


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each is the least of its class; one row of each."""
    classes = near_duplicates(docs, threshold, id_col, text_col)
    least = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_qm_id"), F.col("text_key").alias("_qm_text"))).alias("_k"))
    kept = least.select("_k._qm_id", "_k._qm_text")
    own = docs.columns
    keyed = docs.withColumn("_qm_key", text_key(text_col))
    found = keyed.join(kept.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col("_qm_id")) & (F.col("_qm_key") == F.col("_qm_text")), "left_semi")
    return found.dropDuplicates([id_col, "_qm_key"]).select(*own)
