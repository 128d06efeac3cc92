"""The pipeline: each stage on what its predecessor kept, and all of it."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from quillmill.llm import oracles, pii
from quillmill.llm.encoding import default_tokenizer
from quillmill.llm.scratch import Scratch

from .test_text_ops import classes_by_hand


def test_stages(spark, sf_dir):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        seen.append(scratch.save(stage(spark, seen[-1], sf_dir), f"s{k}"))
    raw, good, single, clean, mixed, packed = seen
    for later in (good, single, clean, mixed):
        assert later.columns == docs.columns

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean_ids = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean_ids) >= 0.97 * len(clean_ids)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())

    rows = [(r.doc_id, r.text) for r in good.collect()]
    # Weighted and plain similarity may differ a little near the threshold.
    loose, strict = (set(classes_by_hand(rows, x).values()) for x in (0.77, 0.83))
    assert loose <= {r.doc_id for r in single.collect()} <= strict

    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.text == pii.redact_text(before[r.doc_id], (*pii.BASE, "account")) and r.n_chars == len(r.text)
        assert not any(s[0] in pii.BASE for s in pii.spans(r.text))

    again = p.mix(spark, clean, sf_dir)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    assert oracles.MIX_WEIGHTS

    tok = Tokenizer.from_file(default_tokenizer())
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    parts = packed.toPandas()
    assert parts.length.sum() == total
    assert (parts.groupby("sequence_id").length.sum() <= 2048).all()
    assert parts.sequence_id.nunique() <= np.ceil(total / 2048) + 1


def test_run_is_all_stages(spark, sf_dir):
    out = p.run(spark, sf_dir)
    again = p.run(spark, sf_dir)
    digest = lambda df: tuple(df.select(F.count("*"), F.sum("ids_crc32"), F.sum("length"), F.countDistinct("sequence_id")).first())
    assert digest(out) == digest(again) and out.count() > 0


def labels_of(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_on_awkward_rows(spark, awkward, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, through every stage."""
    folder = labels_of(spark, tmp_path, [(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (3, None, 0)])
    scratch = Scratch(spark, "test-awkward")
    rows = awkward.collect()
    docs = awkward
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        docs = scratch.save(stage(spark, docs, folder), f"s{k}")
        after = docs.collect()
        if k < 4:
            assert docs.columns == awkward.columns, name
        if name in ("quality classifier", "near-duplicates"):
            assert not set(after) - set(before), name
        if name == "near-duplicates":
            texts = [(r.doc_id, r.text) for r in after]
            assert len(texts) == len(set(texts)) and sum(not (r.text or "") for r in after) <= 1
        if name == "personal data":
            redacted = [(r.doc_id, None if r.text is None else pii.redact_text(r.text, (*pii.BASE, "account"))) for r in before]
            assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(redacted, key=str)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        if name == "source mixing":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0
    assert len(rows) > len(after) - 30 and all(r.offset + r.length <= 2048 for r in after)


def test_stages_on_empty_tables(spark, no_docs, tmp_path):
    folder = labels_of(spark, tmp_path, [])
    for name, stage in p.STAGES:
        out = stage(spark, no_docs, folder)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == no_docs.columns), name


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    folder = labels_of(spark, tmp_path, [])
    no_docs.write.parquet(f"{folder}/documents.parquet")
    assert p.run(spark, folder).count() == 0
