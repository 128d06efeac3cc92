"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import oracles, quality
from quillmill.llm.columns import keeping_columns
from quillmill.llm.encoding import default_tokenizer
from quillmill.llm.mixing import mix_sources
from quillmill.llm.near_dups import keep_one
from quillmill.llm.packing import pack_documents
from quillmill.llm.pii import redact
from quillmill.llm.scratch import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Null or empty text is judged by its metadata, null metadata is a value of
    its own, equal rows share their fate, and without labels of both kinds, or
    documents, nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keeping_columns(docs, ("p_text", "p_meta", "p_quality", "keep"), lambda d: quality.score(d, quality.train(d, labels)).where("keep"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of least id, once.

    Null and empty texts are copies of each other; rows without an id come
    after all others of their class; no documents, no rows.
    """
    return keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by the name of its kind and ``n_chars`` counted anew.

    Null text stays null and has a null count; equal rows stay equal.
    """
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and the hash of its id say, which may be never.

    A null source is a source of its own; a source without characters keeps
    the rate 1; rows that share an id are drawn alike; no documents, no rows.
    """
    return keeping_columns(docs, ("copy", "copies", "shuffle_key"), lambda d: mix_sources(d, oracles.MIX_WEIGHTS, seed=oracles.MIX_SEED))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places.

    Null and empty texts are the end id alone; a null id stays null; each of
    equal rows is packed; no documents, no rows.
    """
    return pack_documents(docs, default_tokenizer(), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: Training, sampled signatures and tokenization have no SQL form; tests hold the pipeline against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
