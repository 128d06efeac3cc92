"""Encoding, Huffman files and packing against the library and plain code."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import huffman, packing
from quillmill.llm.encoding import default_tokenizer, encoder
from quillmill.llm.scratch import Scratch

from .conftest import awkward_rows

PATH = default_tokenizer()
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def unpack(packed):
    return np.frombuffer(packed, encoder(PATH).dtype).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 .,'\n\t éß\u00a0\u2003日<|>\U0001f600"), max_size=40), min_size=1, max_size=5))
def test_encoder_agrees_with_the_library(texts):
    assert [unpack(x) for x in encoder(PATH).encode(texts)] == [ids(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["don't", "a.b,c", "x\ny", "\n", "\n\n", " ", "  ", "\t", "é", "été.", "日本", "12ab", "''s", "²", "…", "<|endoftext|>", "_", "\u00a0", "A", "###"]), max_size=14).map("".join), st.lists(st.sampled_from([" ", "\n", ""]), max_size=3))
def test_encoder_on_joined_kinds(text, ends):
    texts = [text, *(e + text + e for e in ends), text.replace(" ", "\n"), ""]
    assert [unpack(x) for x in encoder(PATH).encode(texts)] == [ids(t) for t in texts]


def test_encoder_forgets_and_learns_again(monkeypatch):
    from quillmill.llm import encoding

    monkeypatch.setattr(encoding, "CACHE_WORDS", 50)
    own = encoding.WordEncoder(PATH)
    for k in range(20):
        texts = [f"head{k} " + " ".join(f"w{j}x{j * k}" for j in range(30)) + f"\nline{k} end"] * 2
        assert [unpack(x) for x in own.encode(texts)] == [ids(t) for t in texts]
    assert len(own.words) < 200


def test_encoder_on_whole_documents(spark, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert [unpack(x) for x in encoder(PATH).encode(texts)] == [ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=800), st.integers(6, 12))
def test_block_round_trip(tokens, limit):
    book = huffman.Codebook(huffman.code_lengths(np.bincount(tokens, minlength=41), limit))
    payload = huffman.encode_block([5, 9], [1, len(tokens) - 1], np.array(tokens, "<u2"), 17, book)
    docs, counts, out, before = huffman.decode_block(payload, book)
    assert (docs.tolist(), counts.tolist(), out.tolist(), before) == ([5, 9], [1, len(tokens) - 1], tokens, 17)


def test_code_lengths_are_limited_and_best():
    fib = [1, 1]
    while len(fib) < 24:
        fib.append(fib[-1] + fib[-2])
    lengths = huffman.code_lengths(np.array(fib), 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) == 1.0
    free = huffman.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 20)
    assert sum(int(a) * b for a, b in zip(free, [5, 9, 12, 13, 16, 45])) == 224  # Huffman's own cost
    assert huffman.code_lengths(np.array([0, 7, 0]), 4).tolist() == [0, 1, 0]


def test_token_files(spark, awkward):
    path = Scratch(spark, "test-files").path
    huffman.write_token_files(awkward, path, PATH, end_id=2)
    got = [tuple(r) for r in huffman.read_token_files(spark, path).orderBy("start").collect()]
    rows = [(r[0], np.array([*ids(r[1]), 2], "<u4")) for r in awkward_rows()]
    place = lambda r: (r[0] is not None, r[0] or 0)
    assert [place(r) for r in got] == sorted(map(place, got))
    assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in got) == sorted((d is None, d or 0, len(x), zlib.crc32(x.tobytes())) for d, x in rows)
    start = 0
    for _, at, n, _ in got:
        assert at == start
        start += n


def test_token_files_of_nothing(spark, no_docs):
    path = Scratch(spark, "test-files").path
    huffman.write_token_files(no_docs, path, PATH, end_id=2)
    assert huffman.read_token_files(spark, path).count() == 0


def held(pieces, capacity):
    """Checks that sequences are gapless and none too long; returns their number."""
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, awkward):
    out = packing.pack_documents(awkward, PATH, capacity=64, end_id=0).collect()
    sequences = held(out, 64)
    total = sum(p.length for p in out)
    assert sequences <= -(-total // 64) + 2
    want = []
    for row in awkward_rows():
        x = np.array([*ids(row[1]), 0], "<u4")
        first = (len(x) - 1) % 64 + 1
        cuts = [0, *range(first, len(x) + 1, 64)]
        want += [(row[0], k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    none = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(none(tuple(p)[:5]) for p in out) == sorted(map(none, want))


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_covers_every_rank(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    counts = {}
    for _ in range(r.randrange(1, 400)):
        n = r.choice([r.randrange(1, capacity + 1), r.randrange(1, max(2, capacity // 4)), capacity // 2])
        counts[n] = counts.get(n, 0) + r.choice([1, 1, 3, 50])
    ranks = {n: [] for n in counts}
    by = {}
    for n, a, b, first, each, offset in packing.plan_runs(counts, capacity):
        ranks[n].append((a, b))
        for k in range(b - a):
            by.setdefault(first + k // each, []).append((offset + k % each * n, n))
    for n, spans in ranks.items():
        at = 0
        for a, b in sorted(spans):
            assert a == at < b
            at = b
        assert at == counts[n]
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    total = -(-sum(n * c for n, c in counts.items()) // capacity)
    assert len(by) <= max(large, total) * 1.25 + 2
