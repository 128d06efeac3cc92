"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, quality
from .clusters import ball_k_means, centroid_digest
from .encoding import default_tokenizer
from .fim import fill_in_middle, restored
from .fingerprints import fingerprint_documents
from .huffman import read_token_files, write_token_files
from .mixing import mix_sources
from .near_dups import near_duplicates
from .ngrams import score_texts
from .packing import pack_documents
from .pii import find_spans
from .scratch import Scratch
from .substrings import remove_repeats
from .topk import exact_top_k
from .url_rules import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "p_text", "p_meta", "p_quality", "keep")


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path
    write_token_files(_table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=2)
    return read_token_files(spark, path)


def op3_kd_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), k=20, scale=64, query_every=20)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(oracles.URL_RULES, "rule string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op6_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_texts", "link_id", "similarity")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), default_tokenizer(), capacity=2048, end_id=0)


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), oracles.MIX_WEIGHTS, seed=oracles.MIX_SEED)


def op10_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(_table(spark, sf_dir, "documents"))


def op11_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op13_ball_k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_k_means(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest().alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
