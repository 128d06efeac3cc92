"""Bucketed tables, keys seen over time and the trigram index against plain code and scans."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmill.operators import filters, stats
from quillmill.operators.search_index import TrigramIndex, id_lists, stretches, trigrams_of
from quillmill.sources.store import BucketTable, SeenKeys

KIND = "url string, n long"


def latest(old, new):
    """The stored row or the new one, by key."""
    return old.select("url", "n", F.lit(0).alias("_w")).unionAll(new.select("url", "n", F.lit(1).alias("_w"))).groupBy("url").agg(F.max_by("n", "_w").alias("n"))


def rows_of(table):
    return sorted((r.url or "", r.n) for r in table.read().collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    table = BucketTable(spark, str(tmp_path / "t"), "url", schema, 8)
    assert table.read().count() == 0
    table.apply(0, spark.createDataFrame([(f"u{k}", k) for k in range(200)], KIND), lambda old, new: new)
    before = table.files()
    assert set(before) == set(range(8))
    batch = spark.createDataFrame([("u7", 700), ("new", 1)], KIND)
    touched = table.apply(1, batch, latest)
    after = table.files()
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == set(touched)
    want = sorted([*((f"u{k}", 700 if k == 7 else k) for k in range(200)), ("new", 1)])
    assert rows_of(table) == want
    assert table.apply(1, batch, lambda old, new: 1 / 0) == [] and table.files() == after  # a replay does nothing


def test_a_batch_that_was_cut_off_is_finished(spark, tmp_path):
    """Buckets that have the batch stay; the others get it."""
    schema = spark.createDataFrame([], KIND).schema
    table = BucketTable(spark, str(tmp_path / "t"), "url", schema, 8)
    add = lambda old, new: old.unionAll(new).groupBy("url").agg(F.sum("n").alias("n"))
    batch = spark.createDataFrame([(f"u{k}", 1) for k in range(50)], KIND)
    table.apply(0, batch, lambda old, new: new)
    table.apply(1, batch.where(table.bucket() < 3), add)  # all that a crashed run had committed
    table.apply(1, batch, add)
    assert rows_of(table) == sorted((f"u{k}", 2) for k in range(50))


def test_merges_in_order_of_buckets_are_written_without_a_shuffle(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    plain, table = (BucketTable(spark, str(tmp_path / x), "url", schema, 8) for x in "pt")
    for k in range(2):
        rows = spark.createDataFrame([(f"u{x}", x + k) for x in range(k * 50, 200)], KIND).repartition(3)
        assert plain.apply(k, rows, latest if k else lambda old, new: new) == table.apply(k, rows, lambda old, new, bucket: old.where("false").unionAll(new).unionAll(old.join(new, "url", "left_anti").select(old.columns)).sortWithinPartitions(bucket), in_buckets=True)
        assert table.apply(k, rows, None, in_buckets=True) == []
        assert rows_of(plain) == rows_of(table)
    assert max(map(len, table.files().values())) > 1 == max(map(len, plain.files().values()))


def test_deleting_rows_and_whole_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    table = BucketTable(spark, str(tmp_path / "t"), "url", schema, 4)
    table.apply(0, spark.createDataFrame([*((f"u{k}", k) for k in range(40)), (None, 5), ("x", None)], KIND), lambda old, new: new)
    before = table.files()
    assert table.delete(1, F.col("n") == 17) and rows_of(table).count(("u17", 17)) == 0
    assert sum(before[b] != f for b, f in table.files().items()) == 1
    gone = {r.url for r in table.read().where(table.bucket() == 2).collect()}
    table.delete(2, table.bucket() == 2)
    assert set(table.files()) == {0, 1, 3} and not gone & {u for u, _ in rows_of(table)}
    table.delete(3, F.lit(True))
    assert table.read().count() == 0 and table.delete(4, F.lit(True)) == []


def test_keys_seen_long_ago_stay_out(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"), 4)
    kind = "url string, at long"
    batches = [[("a", 3), ("a", 1), ("b", 2), (None, 1)], [("c", 9), ("a", 5)], [], [("a", 90), (None, 91), ("", 92), ("d", 93), ("d", 94)]]
    run = lambda k: sorted(((r.url, r.at) for r in seen.first_seen(spark.createDataFrame(batches[k], kind), "url", ["at"], k).collect()), key=str)
    got = [run(k) for k in range(4)]
    assert got == [sorted([("a", 1), ("b", 2), (None, 1)], key=str), [("c", 9)], [], sorted([("", 92), ("d", 93)], key=str)]
    assert run(1) == got[1] and run(3) == got[3]  # a batch that is run again gives the same rows


def test_compaction_keeps_every_key(spark, tmp_path):
    r = random.Random(8)
    seen, plain, known = SeenKeys(spark, str(tmp_path / "seen"), 3), [], set()
    folders = lambda: {(p.parent.name, p.name) for p in (tmp_path / "seen").glob("bucket=*/epoch=*")}
    SeenKeys(spark, str(tmp_path / "none")).compact(5)
    for epoch in range(6):
        rows = [(r.choice([None, "", *map(str, range(40))]), epoch * 100 + k) for k in range(15)]
        run = lambda: sorted(((x.url, x.at) for x in seen.first_seen(spark.createDataFrame(rows, "url string, at long"), "url", ["at"], epoch).collect()), key=str)  # noqa: B023, E731
        first = {}
        for url, at in rows:
            if url not in known:
                first.setdefault(url, at)
        got = run()
        assert got == sorted(first.items(), key=str)
        if epoch in (2, 4):
            seen.compact(epoch)  # the batch of this epoch may still be run again
            assert len(folders()) <= 6 and all(name == f"epoch={epoch}" or name.startswith("epoch=-") for _, name in folders())
            assert run() == got
        known |= set(first)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    words = ["Highway", "high", "HIGH-12", "é́tage", "Straße", "STRASSE", "İstanbul", "\U0001f600\U0001f601\U0001f602", "a.b*c", "a\nb", "x", "%_%", "high low"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 5))), r.choice([None, "", "note", "Ünder"])) for k in range(300)]
    return spark.createDataFrame([*rows, (300, None, None)], "id long, title string, note string")


@pytest.mark.parametrize("q", ["High", "high low", "straß", "étage", "istan", "\U0001f600\U0001f601", "\U0001f600\U0001f601\U0001f602", "b*c", "a\nb", "x", "%_%", "nowhere", "no", "ünder", "", None])
def test_index_search_is_the_scan(texts, tmp_path_factory, q):
    index = TrigramIndex(texts.sparkSession, str(tmp_path_factory.mktemp("i")), "id", ("title", "note"), 8).add(texts)
    want = sorted(r.id for r in filters.search(texts, q, "title", "note").collect())
    assert sorted(r.id for r in index.search(texts, q).collect()) == want


def test_index_search_of_terms_and_changes(spark, texts, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"), "id", ("title", "note"), 8).add(texts)
    for q in ("high ünd", "x high", "x no", "   ", "high -12 note"):
        assert sorted(r.id for r in index.search_terms(texts, q).collect()) == sorted(r.id for r in filters.search_terms(texts, q, "title", "note").collect())
    changed = texts.where("id < 10").withColumn("title", F.lit("something else"))
    index.add(changed)
    now = texts.where("id >= 10").unionAll(changed)
    for q in ("something", "highway", "high"):
        assert sorted(r.id for r in index.search(now, q).collect()) == sorted(r.id for r in filters.search(now, q, "title", "note").collect())


def test_search_reads_only_the_postings_of_its_trigrams(spark, texts, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"), "id", ("title", "note"), 8).add(texts)
    plan = index.candidates(["highway"])._jdf.queryExecution().executedPlan().toString()
    assert trigrams_of("HighWay") == {"hig", "igh", "ghw", "hwa", "way"}
    assert "PartitionFilters: [bucket#" in plan.replace("isnotnull(bucket", "bucket") or "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(gram" in plan.split("PushedFilters: [")[1]


def test_postings_are_a_list_of_ids_for_each_trigram(spark, texts, tmp_path):
    TrigramIndex(spark, str(tmp_path / "i"), "id", ("title", "note"), 8).add(texts.coalesce(1))
    want = {(g, r.id) for r in texts.selectExpr("id", "lower(title) t", "lower(note) n").collect() for text in (r.t, r.n) for g in trigrams_of(text or "")}
    rows = spark.read.parquet(str(tmp_path / "i" / "lists")).collect()
    assert {(r.gram, k) for r in rows for k in r.ids} == want and sum(r.n for r in rows) == len(want)
    assert len(rows) == len({g for g, _ in want}) < len(want) / 10


@pytest.mark.parametrize("limit", [1, 7, 40, 10_000])
def test_stretches_hold_every_row_and_find_every_trigram(limit):
    import pyarrow as pa

    r = random.Random(limit)
    rows = [(r.randrange(9), "".join(r.choice("aé\U0001f600b\n") for _ in range(r.randrange(12))), "".join(r.choice("ab") for _ in range(r.randrange(3)))) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 13])], ["id", "x", "y"]) for k in range(0, 60, 13)]
    tables = list(stretches(iter(batches), limit))
    assert [tuple(x.values()) for t in tables for x in t.to_pylist()] == rows
    assert all(t.num_rows == 1 or sum(len(x["x"].encode()) + len(x["y"]) for x in t.to_pylist()) <= limit for t in tables)
    for t in tables:
        want = {}
        for x in t.to_pylist():
            for g in trigrams_of(x["x"]) | trigrams_of(x["y"]):
                want.setdefault(g, set()).add(x["id"])
        assert {g: ids for g, ids, _ in (tuple(x.values()) for x in id_lists(t).to_pylist())} == {g: sorted(v) for g, v in want.items()}


def test_waits_carry_on(spark):
    kind = "id long, host string, at timestamp"
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s)
    three = spark.createDataFrame([(1, "h", at(0)), (2, "h", at(0.5)), (3, "h", at(0.9))], kind)
    assert [r.wait_s for r in stats.request_starts(three).orderBy("id").collect()] == [0.0, 0.5, 1.1]
    r = random.Random(5)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), at(round(r.random() * 40, 2))) for k in range(120)]
    for slot in ("1 second", "7 seconds", "1 hour"):  # busy hosts are many groups
        got = {x.id: x.wait_s for x in stats.request_starts(spark.createDataFrame(rows, kind), 0.75, slot).collect()}
        last = {}
        for k, h, t in sorted(rows, key=lambda x: (x[2], x[0])):
            start = max(t.timestamp(), last.get(h, 0) + 0.75)
            last[h] = start
            assert abs(got[k] - (start - t.timestamp())) < 1e-5
        assert len(got) == 120
