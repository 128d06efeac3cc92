"""Top-k, URL rules, mixing and the classifier against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing, oracles, quality, topk, url_rules

from .conftest import awkward_rows, prose


def plain_top_k(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    best = {i: max(vs) for i, vs in good.items()}
    for q, qv in best.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in best.items() if i != q and len(v) == len(qv))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("rows_a_shard", [60, 100_000])
def test_top_k(spark, monkeypatch, rows_a_shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", rows_a_shard)
    monkeypatch.setattr(topk, "LEAST_ROWS", rows_a_shard)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "LEAF", 16)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(180)]  # a hot vector: ties everywhere
    rows += [(600 + i, [r.gauss(5 * (i % 4), 0.1) for _ in range(8)]) for i in range(100)]  # clusters that boxes tell apart
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8), (504, [1.0, 2.0]), (520, [2.0, 1.0]), (540, []), rows[20], rows[20], (40, [3.0] * 8), (41, [0.1] * 8)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = sorted(tuple(x) for x in topk.exact_top_k(frame, k=7, query_every=20).collect())
    assert got == plain_top_k(rows, 7, 20)
    assert topk.exact_top_k(frame.limit(0)).count() == 0


def test_top_k_beside_columns_called_like_its_own(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    frame = spark.createDataFrame(rows, VECTORS)
    for name in ("_v", "v", "dim", "cell", "sub", "part", "role", "least", "query_id", "rank", "score", "n"):
        frame = frame.withColumn(name, F.lit("other"))
    result = topk.exact_top_k(frame, k=5)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(x) for x in result.collect()) == plain_top_k(rows, 5, 20)


def test_top_k_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 10)
    monkeypatch.setattr(topk, "LEAST_ROWS", 10)
    r = random.Random(5)
    for size in (3e6, 2e7):  # beyond exact doubles; beyond 62 bits for a bound on products
        rows = [(i, [r.uniform(-1, 1) * (size if i % 20 == 0 else 1e6) for _ in range(3)]) for i in range(60)]
        got = sorted(tuple(x) for x in topk.exact_top_k(spark.createDataFrame(rows, VECTORS), k=5).collect())
        assert got == plain_top_k(rows, 5, 20)


def test_boxes_spare_shards():
    import numpy as np

    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(c, 2, (400, 4)) for c in (-300, 0, 300)]).astype(np.int64)
    cells = topk.Cells(points, 6)
    at = cells.of(points)
    assert cells.cells == 6 and len(set(at.tolist())) == 6
    low, high = (np.array([f(points[at == c], axis=0) for c in range(6)]) for f in (np.min, np.max))
    query = np.array([[290, 300, 310, 300]])
    bound = topk.box_bounds(low, high, query)[0]
    kth = np.sort(points @ query[0])[-20]
    assert 0 < (bound >= kth).sum() <= 3 and all((points[at == c] @ query[0]).max() <= bound[c] for c in range(6))


def test_url_rules(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/7", "allow"), ("com/en/7", "block"), ("example.com/", "allow"), ("a.example.com/x", "block"), ("net", "block"), ("/p", "block"), ("/", "allow"), (None, "block"), ("org/", None)]
    urls = ["http://example.com/en/7", "https://WWW.Example.COM/en/71?x", "http://com/en/", "http://notexample.com/en/7#f", "http://a.example.com/xyz", "http://b.a.example.com/x/y", "ftp://u.net", "http://net?q", None, "no scheme", "", "http://", "http://example.com./en/7", "://x.net/p", "http:///p/q", "http:///q", "http://xn.org/p", "http://a..com/en/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate([*urls, *urls])] + [(None, urls[0], None, None)], "page_id long, url string, key string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    for k, u in enumerate([*urls, *urls]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        met = [(len(r), v == "block", r, v) for r, v in rules if r and v and (h := r.split("/")[0]) is not None and (host == h or h and host.endswith("." + h)) and path.startswith(r[len(h) :])]
        want = max(met)[2:] if met else (None, "allow")
        assert got[k] == (host, path, *want), u
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, "rule string, verdict string")).count() == 0


def test_rules_of_the_query_are_those_of_the_contract(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [(r, v) for v, r in (x.split() for x in contract.split(", "))] == oracles.URL_RULES
    pages = spark.createDataFrame([(1, "https://example.net/de/1"), (2, "https://example.net/de/81"), (3, "https://x.org/es/")], "page_id long, url string")
    got = url_rules.judge_urls(pages, spark.createDataFrame(oracles.URL_RULES, "rule string, verdict string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("org/es/", "block")}


def test_sweep_over_many_ranges(spark):
    r = random.Random(9)
    hosts = [".".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(60)]
    rules = list({h + r.choice(["", "/p", "/q/", "/p/1"]): r.choice(["allow", "block"]) for h in hosts[:25]}.items())
    urls = [(k, f"http://{r.choice(hosts)}/{r.choice(['p', 'q/', 'p/1', ''])}") for k in range(500)]
    got = {x.page_id: (x.rule, x.verdict) for x in url_rules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    for k, u in urls:
        host, _, path = u[7:].partition("/")
        met = [(len(x), v == "block", x, v) for x, v in rules if (h := x.split("/")[0]) and (host == h or host.endswith("." + h)) and ("/" + path).startswith(x[len(h) :])]
        best = max(met)[0] if met else None
        assert got[k] in {(x, v) for n, _, x, v in met if n == best} if met else got[k] == (None, "allow")


def test_mixing(spark, awkward, no_docs):
    out = mixing.mix_sources(awkward, {"src0": 0.5, "absent": 0.2}, seed=3, epochs=8.0)
    assert set(out.columns) == set(awkward.columns) | {"copies", "shuffle_key"}
    rows = out.collect()
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys)
    counts = {}
    for r in rows:
        counts.setdefault(r.doc_id, set()).add((r.copies, r.copy))
    for seen in counts.values():
        (n,) = {c for c, _ in seen}
        assert {c for _, c in seen} == set(range(1, n + 1))
    assert {r.doc_id for r in rows} <= {r[0] for r in awkward_rows()}
    assert mixing.mix_sources(no_docs, {"src0": 0.5}).count() == 0


def test_many_sources_are_joined_in_parts(spark, awkward, monkeypatch):
    hot = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 3 = 0, 'hot', if(id % 50 = 1, NULL, concat('s', id % 40))) AS source")
    for docs in (awkward, hot):
        few = mixing.mix_sources(docs, {"hot": 0.5}, seed=5, epochs=2.0).collect()
        with monkeypatch.context() as patch:
            patch.setattr(mixing, "FEW_SOURCES", 0)
            many = mixing.mix_sources(docs, {"hot": 0.5}, seed=5, epochs=2.0)
            assert "_qm_salt" in many._jdf.queryExecution().optimizedPlan().toString()
            assert sorted(map(str, many.collect())) == sorted(map(str, few))
    assert {r.source for r in few} >= {"hot", None}


def test_means_and_shares(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'0123456789' AS text", "CASE WHEN id % 10 < 7 THEN 'hot' ELSE concat('s', id % 3) END AS source")
    out = mixing.mix_sources(docs, {"hot": 0.25}, seed=1)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] / 5000 - 1) < 0.08 and all(abs(n[f"s{k}"] / 5000 - 1) < 0.08 for k in range(3))
    few = mixing.mix_sources(docs.where("source <> 'hot' OR doc_id < 100"), {"hot": 0.9}, seed=2).groupBy("source").count()
    assert abs({r.source: r["count"] for r in few.collect()}["hot"] / (0.9 * 6070) - 1) < 0.1  # means far above one draw


def test_classifier_on_held_out_rows(spark):
    good = [(k, prose(k, 40 + k % 90), "en", f"s{k % 4}", None) for k in range(600)]
    bad = [(1000 + k, [prose(k, 60).upper().replace(" ", "!! "), " | ".join(prose(k, 60).split()), "buy now " * (20 + k % 30)][k % 3], "en", f"s{k % 4}", 1) for k in range(300)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string, source string, keep int").repartition(4)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in [*good, *bad] if r[0] % 3], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    unseen = [r for r in out if r.doc_id % 3 == 0]
    assert len(out) == 900 and sum(r.keep == (r.doc_id < 1000) for r in unseen) >= 0.97 * len(unseen)


def test_words_told_apart_alike_in_batches_of_any_size(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quillmill.llm.batches import bytes_of

    texts = [prose(1, 30), "a a b", "", None, "x " * 50]
    few = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([5, None, 0, -3, 10**9])], ["_qm_text", "n_chars"])
    many = pa.RecordBatch.from_arrays([pa.array([*texts, *[""] * (1 << 20)]), pa.array([5, None, 0, -3, 10**9, *[0] * (1 << 20)])], ["_qm_text", "n_chars"])
    assert np.array_equal(quality.page_bins(few, *bytes_of(few, "_qm_text")), quality.page_bins(many, *bytes_of(many, "_qm_text"))[:, :5])


def plain_model(rows, labels, rounds, sure):
    """The training by plain loops: counts by hand, the logistic fits of the module."""
    import numpy as np
    import pyarrow as pa

    def feats(row):
        batch = pa.RecordBatch.from_arrays([pa.array([row[1] or ""]), pa.array([row[2]], pa.string()), pa.array([row[3]], pa.string())], ["_qm_text", "lang", "source"])
        slot, _, bins = quality.features(batch)
        return slot.tolist(), bins[:, 0].tolist()

    def add(total, found, text, meta):
        for s in found[0] if text >= 0 else ():
            total[text * quality.TRIGRAMS + s] += 1
        for p, x in enumerate(found[1]) if meta >= 0 else ():
            total[2 * quality.TRIGRAMS + (meta * quality.PROPERTIES + p) * quality.BINS + x] += 1
        if meta >= 0:
            total[-2 + meta] += 1

    def score(model, found):
        text = sum(model.text[s] for s in found[0]) / max(len(found[0]), 1)
        return np.array([[text, *(model.meta[p, x] for p, x in enumerate(found[1]))]])

    found = {r[0]: feats(r) for r in rows}
    marked = {d: x for d, x in labels.items() if d in found}
    held = {d for d in marked if HELD(d)}

    def calibrated(total):
        model = quality.Model(total)
        ids = sorted(held)
        s, y = np.concatenate([score(model, found[d]) for d in ids]), np.array([marked[d] for d in ids], float)
        model.text_fit, model.meta_fit = quality.Logistic.fit(s[:, :1], y), quality.Logistic.fit(s[:, 1:], y)
        logits = np.column_stack([model.text_fit.logit(s[:, :1]), model.meta_fit.logit(s[:, 1:])])
        model.joint = quality.Logistic.fit(np.clip(logits, -12, 12), y)
        return model

    first = np.zeros(quality._SIZE)
    for d in marked.keys() - held:
        add(first, found[d], marked[d], marked[d])
    model = calibrated(first.copy())
    for _ in range(rounds):
        total = first.copy()
        for d in found.keys() - marked.keys():
            text, meta = (p[0] for p in model.views(score(model, found[d])))
            kind = lambda p: 1 if p >= sure else 0 if p <= 1 - sure else -1
            add(total, found[d], kind(meta), kind(text))
        model = calibrated(total)
    return {d: float(model.joint(np.clip(np.column_stack([f.logit(x) for f, x in ((model.text_fit, score(model, found[d])[:, :1]), (model.meta_fit, score(model, found[d])[:, 1:]))]), -12, 12))[0]) for d in found}


HELD = None


def test_classifier_against_plain_loops(spark, monkeypatch):
    from pyspark.sql import functions as F

    good = [(k, prose(k, 30), "en", f"s{k % 3}") for k in range(90)]
    bad = [(100 + k, "buy!! " * 12 + prose(500 + k, 14).upper(), "en", f"s{k % 4}") for k in range(60)]
    labels = {r[0]: int(r[0] < 100) for r in [*good, *bad] if r[0] % 2}
    rows = [*good, *bad]
    held = {r[0] for r in spark.createDataFrame([(d,) for d in labels], "d long").where(F.pmod(F.xxhash64("d", F.lit(1)), F.lit(3)) == 0).collect()}
    monkeypatch.setitem(globals(), "HELD", lambda d: d in held)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    model = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), rounds=2, sure=0.9)
    got = {r.doc_id: r.p_quality for r in quality.score(docs, model).collect()}
    want = plain_model(rows, labels, 2, 0.9)
    assert max(abs(got[d] - want[d]) for d in got) < 1e-6 and len(got) == 150


def test_classifier_edges(spark, awkward, no_docs):
    labels = spark.createDataFrame([(k, None if k == 5 else k % 2) for k in [*range(20), 3, 3]] + [(None, 1)], "doc_id long, quality int")
    model = quality.train(awkward, labels)
    out = quality.score(awkward, model)
    assert out.count() == awkward.count() and [c for c in awkward.columns if c != "keep"] == [c for c in out.columns if c in awkward.columns and c != "keep"]
    assert out.where("p_quality IS NULL OR p_quality < 0 OR p_quality > 1").count() == 0
    assert quality.score(no_docs, model).count() == 0
    assert quality.train(no_docs, labels) is None and quality.train(awkward, labels.where("quality = 1")) is None
    assert quality.score(awkward, None).where("keep").count() == awkward.count()


def test_labelled_rows_are_bounded(spark, monkeypatch):
    """Ids of very many rows count as one row each, so no more rows than ids reach the driver."""
    rows = [(k, prose(k, 20) if k % 2 else "buy!! " * 10 + prose(k, 5), "en", "s") for k in range(40)]
    rows += [(7, prose(1000 + j, 8), "en", "s") for j in range(3000)] + [(8, "buy!! " * 8, "en", "s")] * 500
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    sizes = []
    scores = quality.labelled_scores
    monkeypatch.setattr(quality, "labelled_scores", lambda sample, model: (sizes.append(sample.count()), scores(sample, model))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    model = quality.train(docs, labels)
    assert set(sizes) == {40} and model is not None
    sizes.clear()
    quality.train(docs, labels, max_labelled=12)
    assert set(sizes) == {12}
    assert quality.score(docs, model).count() == len(rows)
