"""Spans, windows, near copies and fingerprints against plain code."""

import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import fingerprints, near_dups, pii, substrings

from .conftest import awkward_rows, edited, prose

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            twice = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text) if good(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "-", " ", "+", "1", "25", "300", "4111 1111 1111 1111", "10.0.0.1", "(555) 123-4567", "x@y.zz", "://", "é", "\U0001f600", "account ", "+1 "]), max_size=25).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    found = pii.spans(text)
    assert [s for s in found if s[0] in pii.BASE] == plain_spans(text)
    base = [s for s in found if s[0] in pii.BASE]
    for _, a, b in (s for s in found if s[0] not in pii.BASE):
        assert not any(a < y and x < b for _, x, y in base)


def test_added_spans_and_redaction():
    text = "Mail a.b@c.org, see https://u.example.com/p?x=1). Account no. DE-449922; IBAN GB82WEST12345698765432 IBAN GB82WEST12345698765433; accounting 123456"
    got = [(k, text[a:b]) for k, a, b in pii.spans(text)]
    assert got == [("email", "a.b@c.org"), ("url", "https://u.example.com/p?x=1"), ("account", "DE-449922"), ("account", "GB82WEST12345698765432")]
    assert pii.redact_text(text, ("email", "account")).startswith("Mail <EMAIL>, see https://u.example.com/p?x=1). Account no. <ACCOUNT>; IBAN <ACCOUNT>")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("token: " + "a1B2" * 20 + " end", "a1B2" * 20),
        ("token: eyJhbGci9012.eyJzdWIi3456.x, then", "eyJhbGci9012.eyJzdWIi3456.x"),
        ("api_key: sk_live_51HxQ2bz99", "sk_live_51HxQ2bz99"),
        ("IBAN GB82 WEST 1234 5698 7654 32 or", "GB82 WEST 1234 5698 7654 32"),
        ("Customer ID 48213.", "48213"),
        ("the Member Id: 99-4821", "99-4821"),
        ("Password: hunter!x and", "hunter!x"),
        ('{"passWord": "correct horse"}', "correct horse"),
        ("password is hunter2x now", "hunter2x"),
        ("account 1234 5678 9012 now", "1234 5678 9012"),
        ("İ token=Zm9v+/YmFyMTIz== end", "Zm9v+/YmFyMTIz=="),
    ],
)
def test_announced_values_are_whole(text, value):
    assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == [value]
    assert value not in pii.redact_text(text, ("account",))


def test_schemes_of_any_length_and_many_spans():
    import time

    scheme = "a" + "b+9" * 30
    assert [text[a:b] for text in [f"9.-{scheme}://host/x."] for k, a, b in pii.spans(text) if k == "url"] == [f"{scheme}://host/x"]
    long = " ".join(f"user{k}@mail.example.com http://h{k}.example.com/p token: k{k}x{k}y77" for k in range(40_000))
    began = time.process_time()
    assert len(pii.spans(long)) == 120_000 and time.process_time() - began < 20


def test_announced_values_beside_base_spans():
    text = "token: abc-10.0.0.1/def and no password needed, passwords are secret, the token of thanks, IBAN GB83 WEST 1234 5698 7654 32"
    assert [(k, text[a:b]) for k, a, b in pii.spans(text) if k != "card"] == [("account", "abc-"), ("ip", "10.0.0.1"), ("account", "/def")]


def test_span_rows(awkward, no_docs):
    want = []
    for r in awkward_rows():
        base = plain_spans(r[1] or "")
        want.append((r[0], *(sum(s[0] == k for s in base) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    got = [tuple(r)[:6] for r in pii.find_spans(awkward).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pii.find_spans(no_docs).count() == 0
    same = pii.redact(awkward)
    assert same.columns == awkward.columns and same.where("text IS NULL").count() == awkward.where("text IS NULL").count()


def plain_repeats(rows, window):
    first = {}
    words = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    order = lambda d: (1, 0) if d is None else (0, d)
    for d, ws in words:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, (2, 0)), order(d))
    out = []
    for d, ws in words:
        gone = {j for k in range(len(ws) - window + 1) if first[tuple(ws[k : k + window])] < order(d) for j in range(k, k + window)}
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats(awkward, no_docs):
    got = substrings.remove_repeats(awkward).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_repeats([r[:2] for r in awkward_rows()], 13)
    assert substrings.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_shared_passages(spark, seed):
    passage = [prose(1000 + seed * 10 + k, 30) for k in range(4)]
    rows = [(d, " ".join(passage[(d * 7 + k) % 4] if (d + k) % 3 else prose(seed * 100 + d * 10 + k, 15) for k in range(5))) for d in range(40)]
    rows += [(40, "a b " * 60), (41, "a b " * 50), (42, "x " * 40)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_repeats(rows, 13)


def test_rows_that_share_an_id(spark):
    rows = [(1, prose(1, 30)), (1, prose(2, 30) + " " + prose(1, 30)), (2, prose(1, 30)), (2, prose(2, 30))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_repeats(rows, 13)


def test_hash_collisions_are_settled_by_bytes(monkeypatch):
    import numpy as np

    from quillmill.llm.batches import bytes_of
    from quillmill.llm.words import Words

    texts = [prose(k, 40) for k in range(6)] + [prose(0, 40), prose(1, 20) + " " + prose(3, 30)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array([0] * 8, pa.int64()), pa.array(texts)], ["doc_id", "text_key", "text"])
    none = np.zeros(0, np.uint64)

    def found():
        rows = [b for b in substrings.pack_windows(1, 1, 13, none)([batch])]
        return sorted((d, tuple(np.frombuffer(x, "<i8").tolist())) for b in substrings.find_repeats(13)(iter(rows)) for d, x in zip(b.column("doc_id").to_pylist(), b.column("intervals").to_pylist()))

    want = found()
    real = substrings.shingle_hashes
    monkeypatch.setattr(substrings, "shingle_hashes", lambda w, n: real(w, n) & np.uint64(3) if n == 13 else real(w, n))
    assert found() == want and want
    assert len(Words(*bytes_of(batch, "text"))) == sum(len(t.split()) for t in texts)


@pytest.mark.parametrize("held", [2_000, 10_000, substrings.HELD_BYTES])
def test_buckets_settled_in_steps_and_hot_minimisers(spark, monkeypatch, held):
    """Boilerplate in most texts, in pieces of few texts, with the greater ids first."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(substrings, "MAP_BYTES", 800)
    monkeypatch.setattr(substrings, "HELD_BYTES", held)
    line = prose(3, 25).replace("\n", " ")
    rows = [(d, f"{prose(d % 37, 20)} {line} {prose(1000 + d, 12)}") for d in reversed(range(80))]
    pieces = []
    for d in range(0, 80, 5):
        part = rows[d : d + 5]
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([0] * 5, pa.int64()), pa.array([r[1] for r in part])], ["doc_id", "text_key", "text"])
        pieces += list(substrings.pack_windows(3, 1, 13, np.zeros(0, np.uint64))([batch]))
    gone = {}
    for b in substrings.find_repeats(13)(iter([pa.concat_batches(pieces).sort_by("bucket")])):
        for d, x in zip(b.column("doc_id").to_pylist(), b.column("intervals").to_pylist()):
            for p, q in np.frombuffer(x, "<i8").reshape(-1, 2).tolist():
                gone.setdefault(d, set()).update(range(p, q))
    assert {d: len(x) for d, x in gone.items()} == {d: g for d, _, g, _ in plain_repeats(rows, 13) if g}
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3_000)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(substrings.hot_minimisers(frame, sum(len(t.encode()) for _, t in rows), 13)) > 0
    got = substrings.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_repeats(rows, 13)


def classes_by_hand(rows, threshold=0.8):
    """Components of exact copies and of pairs whose plain five-word Jaccard similarity is clear of the threshold."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    texts = dict(rows)
    for a in sets:
        for b in sets:
            near = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if any(sets[a]) or any(sets[b]) else 0
            if a < b and (near >= threshold or (texts[a] or "") == (texts[b] or "")):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in sets}


def test_near_classes(spark, no_docs):
    base = [prose(k, 200) for k in range(10)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, edited(base[k % 5], 50 + k, 2)) for k in range(30)]
    rows += [(200 + k, base[7]) for k in range(5)] + [(300, base[8].upper()), (301, "two words"), (302, "two words"), (303, ""), (304, None), (305, prose(999, 200))]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_hand(rows)
    assert near_dups.near_duplicates(no_docs).count() == 0


def test_one_of_each_class_stays(awkward, no_docs):
    kept = near_dups.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) or ids.count(None) >= 1
    assert {3, 4, 5, 15} <= set(ids) and not {12, 13, 14} & set(ids) and ids.count(2) == 1
    assert near_dups.keep_one(no_docs).count() == 0


def test_wide_buckets_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    base = prose(5, 300)
    rows = [(0, base), *((k, edited(base, k, 3)) for k in range(1, 60))]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    strict = classes_by_hand(rows, 0.85)
    sizes = [sum(r.class_id == 0 for r in got), sum(c == 0 for c in strict.values())]
    assert sizes[0] >= 0.9 * sizes[1] > 30


def test_separate_pairs_of_a_wide_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    template = prose(7, 300)
    rows = []
    for k in range(60):
        both = " ".join(f"p{k}x{j}" for j in range(12))
        rows += [(2 * k + side, f"{template} {both} " + " ".join(f"q{k}x{side}x{j}" for j in range(14))) for side in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near = near_dups.similarities(*block_of([t for _, t in rows]), near_dups.inverse_frequencies(*near_dups.document_frequencies(docs))) >= 0.8
    assert all(near[x].nonzero()[0].tolist() == [x & ~1, x | 1] for x in range(120))
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()} == {d: d & ~1 for d, _ in rows}


def test_all_blocks_of_different_classes_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rows = [(1, k, 0 if k < 30 else 30 if k < 45 else k, 100) for k in range(60)] + [(2, k, 0, 100) for k in range(30)]
    as_node = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    members = spark.createDataFrame(rows, "band long, node long, label long, size long").withColumns({c: as_node(c) for c in ("node", "label")})
    got = {}
    for r in near_dups.block_pairs(members).collect():
        got.setdefault((r.band, r.block), set()).add(int.from_bytes(r.node))
    label = {n: x for b, n, x, _ in rows if b == 1}
    assert {b for b, _ in got} == {1}
    assert all(any({x, y} <= s for s in got.values()) for x in label for y in label if label[x] != label[y])
    assert all(len({label[x] for x in s}) > 1 for s in got.values())


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_BYTES", 20_000)
    base = prose(5, 300)
    rows = [(0, base), *((k, edited(base, k, 2)) for k in range(1, 60))]
    assert sum(len(t.encode()) for _, t in rows) > 4 * 20_000
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    strict = classes_by_hand(rows, 0.83)
    assert {d for d, c in strict.items() if c == 0} <= {r.doc_id for r in got if r.class_id == 0}


def test_rows_that_share_an_id(spark):
    """Classes are of texts, whatever the order of the rows and the ids they share."""
    s, t, u = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(5, s), (5, t), (6, s + " word"), (7, t + " word"), (None, u), (5, u + " word"), (None, s), (8, u)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {(r.doc_id, bytes(r.text_key)): r for r in near_dups.near_duplicates(docs).collect()}
        key = lambda x: hashlib.md5(x.encode()).digest()
        members = {}
        for (i, k), r in got.items():
            members.setdefault(r.class_id, set()).add((i, k))
        want = [{(5, key(s)), (6, key(s + " word")), (None, key(s))}, {(5, key(t)), (7, key(t + " word"))}, {(None, key(u)), (5, key(u + " word")), (8, key(u))}]
        assert sorted(map(len, members.values())) == [2, 3, 3] and all(w in members.values() for w in want)
        assert sum(c == 5 for c in members) == 1 and sum(c < 0 for c in members) == 2
        assert got[6, key(s + " word")].link_id == 5 and got[5, key(t)].link_id == 7 and got[5, key(u + " word")].link_id == 8
        kept = sorted((r.doc_id, r.text) for r in near_dups.keep_one(docs).collect())
        assert kept == sorted([(5, s), (5, t), (5, u + " word")])


def test_negative_and_extreme_ids(spark):
    s = prose(4, 100)
    low, high = -(1 << 63), (1 << 63) - 1
    for ids in ((low, -3, 0), (-3, 0, high), (high, None, low), (None, high, 4)):
        docs = spark.createDataFrame([(i, s if k else s + " word") for k, i in enumerate(ids)], "doc_id long, text string")
        least = min(i for i in ids if i is not None)
        assert {r.class_id for r in near_dups.near_duplicates(docs).collect()} == {least}
        assert [r.doc_id for r in near_dups.keep_one(docs).collect()] == [least]


def test_links_are_verified_pairs(spark):
    base = [prose(k, 200) for k in range(4)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10 + k, edited(base[k], k, 2)) for k in range(3)] + [(20, base[0]), (21, edited(base[0], 90, 3))]
    got = {r.doc_id: r for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].link_id is None and got[3].similarity is None
    assert (got[1].link_id, got[11].link_id, got[2].link_id, got[12].link_id) == (11, 1, 12, 2)
    assert got[20].link_id == got[0].link_id in (10, 21) and all(0.8 <= r.similarity < 1 for r in got.values() if r.link_id is not None)
    assert all(got[r.link_id].class_id == r.class_id for r in got.values() if r.link_id is not None)


def test_load_of_rare_shingles_does_not_count():
    import numpy as np

    r = np.random.default_rng(1)
    for docs in (100_000, 15_000_000):
        counts = r.poisson(400 * docs / near_dups.SLOTS, near_dups.SLOTS)
        counts[:10] += docs // 3
        idf = near_dups.inverse_frequencies(counts, docs)
        assert idf[10:].min() > 1.98 and abs(idf[:10] - 1 - np.log(3) / np.log(1002)).max() < 0.01


def test_recall_over_documents(spark, sf_dir):
    """Against all pairs of the weighted Jaccard similarity itself."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near = near_dups.similarities(*block_of([t for _, t in rows]), near_dups.inverse_frequencies(*near_dups.document_frequencies(docs)))
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    pairs = [(rows[x][0], rows[y][0]) for x, y in zip(*(near >= 0.8).nonzero()) if x < y]
    met = sum(got[x] == got[y] for x, y in pairs)
    assert len(pairs) > 20 and met >= 0.98 * len(pairs)


def test_prefixes_of_texts_at_the_threshold_meet():
    import numpy as np

    idf = np.linspace(1, 2, near_dups.SLOTS).astype(np.float32)
    block = block_of([edited(prose(3, 200), k, k % 9) for k in range(40)] + ["a b c d e f " * k for k in range(10, 20)])
    owner, features = near_dups.prefixes(*block, idf, 0.8)
    sets = [set(features[owner == k].tolist()) for k in range(50)]
    near = near_dups.similarities(*block, idf) >= 0.8
    assert near.sum() > 100 and all(sets[x] & sets[y] for x, y in zip(*near.nonzero()))


def block_of(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return near_dups.shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_similarities_of_a_block():
    import numpy as np

    idf = np.linspace(1, 2, near_dups.SLOTS).astype(np.float32)
    texts = [prose(1, 80), edited(prose(1, 80), 3, 2), "a b c d e f " * 20, "a b c d e f " * 15, prose(2, 40), "", "one two"]
    ids, counts, at = block_of(texts)
    got = near_dups.similarities(ids, counts, at, idf)
    weigh = [dict(zip(ids[x:y].tolist(), (counts[x:y] * idf[near_dups.slots(ids[x:y])]).tolist())) for x, y in zip(at, at[1:])]
    for i, a in enumerate(weigh):
        for j, b in enumerate(weigh):
            keys = {*a, *b}
            most = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
            want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / most if most else 0
            assert i == j or abs(got[i, j] - want) < 1e-6


def test_sampling_estimates_similarity():
    import numpy as np

    idf = np.linspace(1, 2, near_dups.SLOTS).astype(np.float32)
    base = prose(11, 400)
    for n in (2, 8, 25):
        ids, counts, at = block_of([base, edited(base, n, n)])
        drawn = [near_dups.sample(ids[x:y], counts[x:y] * idf[near_dups.slots(ids[x:y])]) for x, y in zip(at, at[1:])]
        assert abs(near_dups.similarities(ids, counts, at, idf)[0, 1] - np.mean(drawn[0] == drawn[1])) < 0.2


def plain_vector(text):
    out = [0] * (fingerprints.WHOLE + fingerprints.LANES)
    if text:
        for line in text.split("\n"):
            h = hashlib.sha256(line.encode()).hexdigest()
            for k in range(fingerprints.WHOLE):
                out[k] = (out[k] + int(h[8 * k : 8 * k + 8], 16)) % 2**32
        for s in [*re.findall("[^ \n]+(?: [^ \n]+){3}", re.sub("([.!?]) ", "\\1\n", text)), *filter(None, text.split("\n"))]:
            v = int(hashlib.md5(s.encode()).hexdigest()[:4], 16) % (2 * fingerprints.LANES)
            k = fingerprints.WHOLE + v // 2
            out[k] = (out[k] + (-1 if v % 2 else 1)) % 2**32
    return out


def test_fingerprints(awkward, no_docs):
    rows = sorted(((r[0], r[1] or "") for r in awkward_rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = sorted((tuple(r) for r in fingerprints.fingerprint_documents(awkward).collect()), key=str)
    want = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        v, e, n = plain_vector(text), plain_vector(new), plain_vector(after)

        def like(a, b):
            x, y = ([z - 2**32 if z >= 2**31 else z for z in v[fingerprints.WHOLE :]] for v in (a, b))
            dot = lambda p, q: float(sum(i * j for i, j in zip(p, q)))
            size = math.sqrt(dot(x, x) * dot(y, y))
            return 1.0 if a == b else max(0.0, min(1.0, dot(x, y) / size)) if size else 0.0

        text_of = lambda a: "".join(f"{x:08x}" for x in a)
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), text_of(v), text_of(e), like(v, e), like(v, n)))
    assert got == sorted(want, key=str)
    assert fingerprints.fingerprint_documents(no_docs).count() == 0


@pytest.mark.parametrize("sentences", [30, 300, 3000])
def test_likeness_holds_at_any_length(spark, sentences):
    text = lambda seed: " ".join(prose(seed * 10_000 + k, 9).replace("\n", " ") + "." for k in range(sentences))
    rows = [(k, text(k)) for k in range(6)]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(abs(r.near_edited - 2 / 3) < 0.2 and r.near_next < 0.25 for r in got)
    assert abs(sum(r.near_edited for r in got) / 6 - 2 / 3) < 0.08


def test_paragraphs_may_move_and_go(spark):
    a, b = "first line.\nsecond line.\nthird", "third\nfirst line.\nsecond line."
    rows = fingerprints.with_vector(spark.createDataFrame([(a,), (b,), ("first line.\nsecond line.",), ("third",)], "t string"), "t", "v").collect()
    va, vb, part, rest = (r.v for r in rows)
    assert va == vb != part
    frame = spark.createDataFrame([(va, part, rest)], "w array<long>, p array<long>, r array<long>")
    row = frame.select(fingerprints.combine(F.col("p"), F.col("r")), fingerprints.combine(F.col("w"), F.col("r"), -1)).first()
    assert (row[0], row[1]) == (va, part)
