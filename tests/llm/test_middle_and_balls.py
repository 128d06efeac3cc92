"""Fill-in-middle and ball k-means against plain code."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import clusters
from quillmill.llm.clusters import ball_k_means, centroid_digest, reassign
from quillmill.llm.fim import fill_in_middle, restored

from .conftest import awkward_rows, prose


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_middles_of_awkward_rows(spark, awkward, no_docs):
    made = fill_in_middle(awkward)
    assert made.columns == [*awkward.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    assert got == Counter((r[0], r[1], *by_hand(r[0], r[1])) for r in awkward_rows())
    assert made.where(~(restored() == F.coalesce("text", F.lit("")))).isEmpty()
    assert fill_in_middle(no_docs).count() == 0


def test_middles_of_marks_and_planes(spark):
    r = random.Random(2)
    pieces = ["<", "P", ">", "<P>", "<S", "S>", "<M>", "\U0001f600", "é", "\n", "\r\n", " ", "a", "<<P", "\x00"]
    rows = [(k, "".join(r.choice(pieces) for _ in range(r.randrange(1, 9)))) for k in range(600)]
    rows += [(1000 + k, "<" * k + "\U0001f600") for k in range(60)] + [(2000, prose(1, 40_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle(docs).withColumn("back", restored())
    found = {x.doc_id: x for x in made.collect()}
    for doc_id, text in rows:
        x = found[doc_id]
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == by_hand(doc_id, text)
        assert x.back == text
    assert {x.form for x in found.values()} == {"plain", "psm", "spm"}


def test_middles_replace_columns_and_keep_shares(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'some words of text' AS text", "'x' AS form", "1 AS Output", "2 AS n")
    made = fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    share = {r["form"]: r["count"] / 4000 for r in made.groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.03 and abs(share["spm"] - 0.18) < 0.03
    assert fill_in_middle(docs, plain_percent=0, spm_percent=100).where("form = 'spm'").count() == 4000


def test_middles_need_no_shuffle_and_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = fill_in_middle(docs).withColumn("back", restored())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def lloyd(rows, k, rounds, scale, dims):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-clusters.largest(dims), min(clusters.largest(dims), x)) for x in v]) for i, v in kept]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in last:
        total[j] += d
    long = lambda x: x if x < 1 << 63 else None
    return Counter((i, j, d, long(total[j]), long(sum(total.values())), tuple(centroids[j])) for i, d, j in last)


VECTORS = "vec_id long, embedding array<double>, cluster string, distance int"


def awkward_vectors(r, dims):
    rows = [(i, [r.gauss(3 * (i % 5), 0.7) for _ in range(dims)]) for i in range(150)]
    rows += [(200 + i, [0.25] * dims) for i in range(90)]  # one hot vector
    rows += [(300 + i, [0.25 if i % 2 else -0.25] + [0.0] * (dims - 1)) for i in range(20)]  # ties
    rows += [(400, None), (401, [1.0, None] + [0.0] * (dims - 2)), (402, [float("nan")] * dims), (403, [float("-inf")] * dims), (404, [1.0]), (405, []), (406, [0.0] * (dims + 1))]
    return [*rows, (None, [0.5] * dims), (None, None), (7, [9.0] * dims), rows[3], rows[3]]


@pytest.mark.parametrize("block,dims,k", [(16, 4, 6), (4096, 4, 8), (16, 64, 8), (7, 3, 1)])
def test_balls_are_lloyd(spark, monkeypatch, block, dims, k):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rows = awkward_vectors(random.Random(dims), dims)
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS).repartition(3)
    got = ball_k_means(frame, k=k, rounds=4, scale=8, dims=dims)
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got.collect()) == lloyd(rows, k, 4, 8, dims)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("qm_balls")]


def test_balls_of_few_and_far_vectors(spark):
    far = [(1, [1e300, -1e300]), (2, [-1e300, 1e300]), (3, [0.0, 0.0]), (4, [1e300, 1e300])]
    for rows in (far, far[2:3], [far[2]] * 5):
        got = ball_k_means(spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS), k=3, rounds=2, scale=1024, dims=2)
        assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got.collect()) == lloyd(rows, 3, 2, 1024, 2)
    empty = spark.createDataFrame([], VECTORS)
    assert ball_k_means(empty).collect() == [] and ball_k_means(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_balls_spare_comparisons():
    r = np.random.default_rng(4)
    centers = r.integers(-4000, 4000, (16, 8))
    vectors = (centers[r.integers(0, 16, 4000)] + r.integers(-40, 40, (4000, 8))).astype(np.int64)
    best, nearest, _ = reassign(vectors, np.zeros(4000, np.int64), centers)
    again, same, compared = reassign(vectors, best, centers)
    whole = np.stack([clusters.squared(vectors, c) for c in centers])
    assert (best == whole.argmin(axis=0)).all() and (nearest == whole.min(axis=0)).all()
    assert (again == best).all() and (same == nearest).all()
    assert compared == 4000  # every vector is in a stable core


def test_rounds_shuffle_no_vectors(spark, monkeypatch, sf_dir):
    plans = []
    keep = clusters.Bucketed.save
    monkeypatch.setattr(clusters.Bucketed, "save", lambda self, df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(self, df, name))[1])
    ball_k_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rounds=2).select(centroid_digest()).collect()
    assert len(plans) == 4
    assert all("Exchange" not in plan for name, plan in plans if name.startswith("state"))
