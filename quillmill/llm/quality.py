"""Quality by co-training: a text view and a page-metadata view teach each other.

The text view is naive Bayes over hashed byte trigrams.  The metadata view is
naive Bayes over binned properties of the page: source, language, stated and
real length and layout (lines, letter case, marks, digits, spaces, repeated lines and words);
it sees no word.  Both models are sums of counts, so learning from all
documents is one pass whose result has a fixed size.

1. A bounded sample of labelled rows starts both models: at most ``max_labelled``
   ids, those of least hash, and of the rows of an id the one of least hash.  A
   third of it is held back.
2. Each round every document is scored by both views.  A document of which one
   view is sure (calibrated probability beyond ``sure`` or below ``1 - sure``)
   becomes an example for the other view's next model.
3. After each round a logistic fit on the held-back rows calibrates each view
   (the text's mean log-odds; the log-odds of each property), and then the two
   views together.

Defined results: null text is empty text and is judged by its metadata; null
metadata is a value of its own; without labels of both kinds nothing can be
learnt and every document is kept with probability 1; repeated rows are scored
alike; extra columns are kept, and columns named like a score are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import by_text_size, bytes_of
from .scratch import Scratch
from .sums import sum_arrays
from .words import Words

TRIGRAMS = 1 << 14
#: Columns of the page's metadata, where the table has them (``n_chars`` as a number).
METADATA = ("source", "lang", "n_chars")
BINS, PROPERTIES = 64, 12
_SIZE = 2 * TRIGRAMS + 2 * PROPERTIES * BINS + 2  # by class: trigrams, bins, examples of the metadata view
SCORES = "p_text double, p_meta double, p_quality double, keep boolean"
_UPPER, _MARK, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[33:127] = True
_MARK[65:91] = _MARK[97:123] = _MARK[48:58] = False


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` within bounds, which may be empty."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(x + 1) * 2, BINS - 1).astype(np.int64)


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    share = np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)
    return np.minimum(np.sqrt(share) * (BINS - 1), BINS - 1).astype(np.int64)


def _name_bins(values: list) -> np.ndarray:
    return np.array([0 if v is None else 1 + zlib.crc32(str(v).encode()) % (BINS - 1) for v in values], np.int64)


def page_bins(batch: pa.RecordBatch, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``PROPERTIES`` bins of every row."""
    n = batch.num_rows
    size = np.diff(bounds).astype(np.float64)
    newline = raw == 10
    lines = _per(newline, bounds) + 1
    upper, mark, digit, space = (_per(t[raw], bounds) for t in (_UPPER, _MARK, _DIGIT, _SPACE))
    letters = np.maximum(size - mark - digit - space, 0)
    words = Words(raw, bounds)
    counts = np.diff(words.first).astype(np.float64)
    short = words.hash >> np.uint64(20)
    if n < 1 << 20:  # both keys in one number sort faster
        pair = np.sort(words.text.astype(np.uint64) << np.uint64(44) | short)
        owner, short = (pair >> np.uint64(44)).astype(np.int64), pair
    else:
        order = np.lexsort((short, words.text))
        owner, short = words.text[order], short[order]
    fresh = np.concatenate([[True], (short[1:] != short[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else np.zeros(0, bool)
    distinct = np.bincount(owner[fresh], minlength=n)[:n]
    again = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1]) if len(words) else np.zeros(0, bool)
    twice = np.bincount(words.text[1:][again], minlength=n)[:n] if len(words) else np.zeros(n)
    # Case of letters beyond ASCII is not looked at; the share is of all letters.
    columns = {c.lower(): c for c in batch.schema.names}
    known = batch.column(columns["n_chars"]).cast(pa.float64(), safe=False).fill_null(-1).to_numpy(zero_copy_only=False) if "n_chars" in columns else np.full(n, -1.0)
    stated = np.where(known >= 0, 1 + _log_bin(np.maximum(known, 0)), 0).clip(0, BINS - 1)
    name = [_name_bins(batch.column(columns[c]).to_pylist()) if c in columns else np.zeros(n, np.int64) for c in ("source", "lang")]
    return np.stack([
        *name, stated, _log_bin(size), _log_bin(size / lines), _share_bin(upper, letters), _share_bin(mark, size), _share_bin(digit, size), _share_bin(space, size),
        _share_bin(distinct, np.sqrt(np.maximum(counts, 1)) * 8 + counts), _share_bin(twice, counts), _log_bin(size / np.maximum(counts, 1) * 4),
    ])


def trigram_slots(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each byte trigram, and the texts' bounds among them (spans of two texts are left out)."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    x = raw.astype(np.uint32)
    code = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
    slot = (code >> np.uint32(18)).astype(np.int64)
    inside = np.ones(len(slot), bool)
    edges = bounds[1:-1]
    for back in (1, 2):
        at = edges - back
        inside[at[(at >= 0) & (at < len(slot))]] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return slot[inside], kept[np.minimum(bounds, len(slot))]


@dataclass
class Logistic:
    """Probability from a few scores; fitted by Newton steps with a small ridge."""

    weights: np.ndarray

    @classmethod
    def fit(cls, scores: np.ndarray, labels: np.ndarray) -> Logistic:
        x = np.column_stack([scores, np.ones(len(labels))])
        w = np.zeros(x.shape[1])
        ridge = np.eye(x.shape[1]) * 0.1
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (labels - p) - ridge @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return cls(w)

    def logit(self, scores: np.ndarray) -> np.ndarray:
        return scores @ self.weights[:-1] + self.weights[-1]

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(scores), -30, 30)))


@dataclass
class Model:
    """Weights of both views from counts by class (0, 1), with their calibrations."""

    counts: np.ndarray
    text_fit: Logistic | None = None
    meta_fit: Logistic | None = None
    joint: Logistic | None = None
    text: np.ndarray = field(init=False)
    meta: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        t = self.counts[: 2 * TRIGRAMS].reshape(2, TRIGRAMS) + 0.5
        t = np.log(t / t.sum(axis=1, keepdims=True))
        self.text = t[1] - t[0]
        m = self.counts[2 * TRIGRAMS : -2].reshape(2, PROPERTIES, BINS) + 0.5
        m = np.log(m / m.sum(axis=2, keepdims=True))
        self.meta = m[1] - m[0]

    def raw_scores(self, slot: np.ndarray, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        text = _per(self.text[slot], at) / np.maximum(n, 1)
        return np.column_stack([text, self.meta[np.arange(PROPERTIES)[:, None], bins].T])

    def views(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text_fit(scores[:, :1]), self.meta_fit(scores[:, 1:])


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, bounds = bytes_of(batch, "_qm_text")
    return *trigram_slots(raw, bounds), page_bins(batch, raw, bounds)


def add_examples(total: np.ndarray, slot: np.ndarray, at: np.ndarray, bins: np.ndarray, text_class: np.ndarray, meta_class: np.ndarray) -> None:
    """Adds rows to ``total``; class -1 leaves a row out of a view."""
    owner = np.repeat(text_class, np.diff(at))
    taken = owner >= 0
    total[: 2 * TRIGRAMS] += np.bincount(owner[taken] * TRIGRAMS + slot[taken], minlength=2 * TRIGRAMS)
    rows = np.flatnonzero(meta_class >= 0)
    place = meta_class[rows] * (PROPERTIES * BINS) + np.arange(PROPERTIES)[:, None] * BINS + bins[:, rows]
    total[2 * TRIGRAMS : -2] += np.bincount(place.ravel(), minlength=2 * PROPERTIES * BINS)
    total[-2:] += np.bincount(meta_class[rows], minlength=2)


def labelled_scores(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and labels of the held-back rows, of which there are at most ``max_labelled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches, "_qm_text"):
            s = model.raw_scores(*features(batch))
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(list(s), pa.list_(pa.float64()))], ["label", "scores"])

    rows = sample.where("_held").mapInArrow(run, "label int, scores array<double>").collect()
    return np.array([r[1] for r in rows], float).reshape(-1, 1 + PROPERTIES), np.array([r[0] for r in rows], float)


def calibrate(model: Model, sample: DataFrame) -> Model:
    scores, labels = labelled_scores(sample, model)
    model.text_fit, model.meta_fit = Logistic.fit(scores[:, :1], labels), Logistic.fit(scores[:, 1:], labels)
    logits = np.column_stack([model.text_fit.logit(scores[:, :1]), model.meta_fit.logit(scores[:, 1:])])
    model.joint = Logistic.fit(np.clip(logits, -12, 12), labels)
    return model


def train(docs: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.97, max_labelled: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The co-trained model, or None if the labels are not of both kinds."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.withColumn("_qm_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("_id", F.col(id_col).cast("long"))
    rows = rows.select("_id", "_qm_text", *[c for c in docs.columns if c.lower() in METADATA])
    marked = labels.select(F.col(id_col).cast("long").alias("_lid"), F.col(label_col).cast("int").alias("_label")).dropna().groupBy("_lid").agg(F.min("_label").alias("_label"))
    # At most `max_labelled` ids and labels, so the broadcast is bounded.
    chosen = F.broadcast(marked.orderBy(F.xxhash64("_lid"), "_lid").limit(max_labelled))
    sample = rows.join(chosen, F.col("_id") == F.col("_lid")).withColumn("_held", F.pmod(F.xxhash64("_lid", F.lit(1)), F.lit(3)) == 0).drop("_lid")
    # One row an id, taken before the shuffle as well as after it; so there are no more rows than ids.
    own = [c for c in rows.columns if c != "_id"]
    sample = sample.withColumn("_row", F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64(*own), *own))).where("_row = 1").drop("_row")
    sample = scratch.save(sample, "labelled")

    def from_labels(total: np.ndarray, batch: pa.RecordBatch) -> None:
        kind = np.where(batch.column("_held").to_numpy(zero_copy_only=False), -1, batch.column("_label").to_numpy(zero_copy_only=False) > 0)
        add_examples(total, *features(batch), kind, kind)

    first = sum_arrays(sample, _SIZE, from_labels, "_qm_text")
    if first[-2:].min() < 1 or sample.where("_held").select("_label").distinct().count() < 2:
        return None
    model = calibrate(Model(first), sample)
    held = sample.select(F.col("_id").alias("_known")).distinct()
    others = rows.join(F.broadcast(held), F.col("_id") == F.col("_known"), "left_anti")
    for _ in range(rounds):

        def from_other_view(total: np.ndarray, batch: pa.RecordBatch, model: Model = model) -> None:
            found = features(batch)
            p_text, p_meta = model.views(model.raw_scores(*found))
            by_text, by_meta = (np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1)) for p in (p_text, p_meta))
            add_examples(total, *found, by_meta, by_text)

        model = calibrate(Model(first + sum_arrays(others, _SIZE, from_other_view, "_qm_text")), sample)
    scratch.drop()
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = 0.4, text_col: str = "text") -> DataFrame:
    """The input's columns with both views' probabilities, the joint one and the decision."""
    names = [c.split()[0] for c in SCORES.split(", ")]
    docs = docs.drop(*names)
    own = docs.columns
    if model is None:
        one = F.lit(1.0)
        return docs.withColumns(dict(zip(names, (one, one, one, F.lit(True)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches, "_qm_text"):
            scores = model.raw_scores(*features(batch))
            p_text, p_meta = model.views(scores)
            logits = np.column_stack([model.text_fit.logit(scores[:, :1]), model.meta_fit.logit(scores[:, 1:])])
            p = model.joint(np.clip(logits, -12, 12))
            keep = batch.select(own)
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(p_text), pa.array(p_meta), pa.array(p), pa.array(p >= threshold)], [*own, *names])

    schema = docs.schema
    for c in SCORES.split(", "):
        schema = schema.add(*c.split())
    return docs.withColumn("_qm_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, schema)
