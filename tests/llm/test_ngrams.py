"""Elias-Fano sequences, the levels of the trie and text scores against plain code."""

import math
import mmap
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import ngrams
from quillmill.llm.elias_fano import EliasFano
from quillmill.llm.ngrams import STEPS, Level, pack, score_texts, unpack

from .conftest import awkward_rows, prose


@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**40), st.integers(0, 2**64 - 1)), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=200, deadline=None)
def test_sequences(numbers, others):
    values = np.array(sorted(numbers), np.uint64)
    data = b"12345678" + EliasFano.of(values).to_bytes()
    seq, end = EliasFano.view(memoryview(data), 8)
    assert end == len(data) and len(seq) == len(values)
    assert seq.access(np.arange(len(values))).tolist() == values.tolist()
    asked = np.array([*numbers, *others, 0, 2**64 - 1], np.uint64)
    assert seq.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    have = set(numbers)
    assert [int(i) >= 0 for i in seq.find(asked)] == [int(x) in have for x in asked]


def test_sequences_are_small():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 200_000, dtype=np.uint64))
    bits = 8 * len(EliasFano.of(values).to_bytes()) / len(values)
    assert bits < math.log2((1 << 40) / len(values)) + 5


def test_packed_arrays():
    a, b, c = np.arange(5, dtype=np.uint64) << np.uint64(50), np.zeros(0, np.uint32), np.array([7], np.uint8)
    assert [x.tolist() for x in unpack(pack(a, b, c), np.uint64, np.uint32, np.uint8)] == [a.tolist(), [], [7]]


def test_level_in_a_mapped_file(tmp_path):
    r = np.random.default_rng(2)
    key = np.unique(np.stack([r.integers(0, 50, 3000), r.integers(0, 400, 3000)], axis=1), axis=0)
    cell = (np.sort(r.integers(0, 2**64 - 1, 50, dtype=np.uint64)))[key[:, 0]]
    word, count = key[:, 1].astype(np.uint32) * 7919, r.integers(1, 9, len(key))
    (tmp_path / "level").write_bytes(Level.build(cell, word, count, 0.75))
    with open(tmp_path / "level", "rb") as f:
        level = Level(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
        asked = np.append(np.unique(cell), np.uint64(5))
        place, weight = level.contexts(asked)
        n, t = level.counts(place)
        assert place[-1] == -1 and n[-1] == t[-1] == weight[-1] == 0
        for c in range(len(asked) - 1):
            mine = cell == asked[c]
            assert n[c] == count[mine].sum() and t[c] == mine.sum()
            assert abs(math.log10(ngrams.VALUE[weight[c]]) - math.log10(0.75 * t[c] / n[c])) <= 0.5 / STEPS + 1e-9
        places = np.searchsorted(asked, cell)
        codes = level.after(place[places], word)
        assert np.abs(np.log10(ngrams.VALUE[codes]) - np.log10((count - 0.75) / n[places])).max() <= 0.5 / STEPS + 1e-9
        assert (level.after(place[places], word + np.uint32(1)) == 0).all()
        assert (level.after(np.full(3, -1), word[:3]) == 0).all()


def plain_scores(rows, order, discount=0.75):
    """The model by dictionaries, with probabilities and weights on the same scale of bytes."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    texts = [(i, split(t)) for i, t in rows]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1
    after, words = defaultdict(Counter), Counter()
    for i, ws in texts:
        if not held(i):
            words.update(ws)
            line = [None] * (order - 1) + ws
            for at in range(order - 1, len(line)):
                for k in range(1, order):
                    after[tuple(line[at - k : at])][line[at]] += 1
    total, vocabulary = sum(words.values()), len(words)
    code = lambda p: 10 ** (-(min(max(round(-math.log10(p) * STEPS), 0), 254)) / STEPS)

    def p_of(context, w):
        if not context:
            return (words[w] + 0.5) / (total + 0.5 * (vocabulary + 1))
        shorter, seen = p_of(context[1:], w), after.get(context)
        if not seen:
            return shorter
        n = sum(seen.values())
        return (code((seen[w] - discount) / n) if seen[w] else 0.0) + code(discount * len(seen) / n) * shorter

    out = []
    for i, ws in texts:
        line = [None] * (order - 1) + ws
        score = sum(math.log10(p_of(tuple(line[at - order + 1 : at]), line[at])) for at in range(order - 1, len(line)))
        out.append((i, held(i), len(ws), sum(words[w] > 0 for w in ws), total, sum(math.log10(p_of((), w)) for w in ws), score))
    return out


def agree(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_awkward_rows(spark, awkward, no_docs, order):
    got = score_texts(awkward, order=order)
    assert got.columns == COLUMNS
    agree(got.collect(), plain_scores([(r[0], r[1]) for r in awkward_rows()], order))
    assert score_texts(no_docs, order=order).collect() == [] and score_texts(no_docs).columns == COLUMNS


@pytest.mark.parametrize("grams", [2000, 1 << 20])
def test_scores_over_many_chunks_and_shards(spark, monkeypatch, sf_dir, grams):
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 3000)
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", grams)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    agree(score_texts(docs, order=3, word_bits=32).collect(), plain_scores(rows, 3))


def test_hot_contexts_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 4000)
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 200)
    # Half of all words are "of" and a pair is before very many words.
    rows = [(k, " ".join(f"of the {prose(100 * k + j, 1)}{j} of x{j % 7}" for j in range(80))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    find = ngrams.hot_contexts
    monkeypatch.setattr(ngrams, "hot_contexts", lambda *a: seen.append(find(*a)) or seen[-1])
    got = score_texts(docs, order=3).collect()
    assert all(len(contexts) and parts.min() >= 2 for contexts, parts in seen[0].values())
    agree(got, plain_scores(rows, 3))


def test_few_bits_of_words_cost_little(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = [score_texts(docs, word_bits=bits).groupBy("held_out").sum("score").orderBy("held_out").collect() for bits in (24, 32)]
    for a, b in zip(*sums):
        assert a[1] == pytest.approx(b[1], rel=1e-4)


def test_nothing_to_learn_from(spark):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1]
    docs = spark.createDataFrame([(k, "some words") for k in ids], "doc_id long, text string")
    got = score_texts(docs).collect()
    assert {tuple(r)[1:] for r in got} == {(True, 3, 0, 0, 0.0, 0.0)}


def test_held_out_texts_are_likelier_than_by_the_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = {k: score_texts(docs, order=k).where("held_out").selectExpr("sum(base_score)", "sum(score)").first() for k in (2, 3)}
    assert sums[2][1] > sums[2][0] and sums[3][1] > sums[2][1]


def test_levels_are_kept(spark, awkward, tmp_path):
    score_texts(awkward, order=3, levels_to=str(tmp_path / "levels")).count()
    levels = spark.read.parquet(str(tmp_path / "levels")).collect()
    assert {r.order for r in levels} == {2, 3}
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert sum(int(Level(memoryview(bytes(r.level))).running.access(np.array([len(Level(memoryview(bytes(r.level))).cells)]))[0]) for r in levels if r.order == 2) == plain_scores(rows, 2)[0][4]
