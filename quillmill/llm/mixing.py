"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters over
its present share.  Each document gets a uniform number from a hash of seed
and id, the inverse of the Poisson distribution with that mean turns it into a
count of copies, and the copies are put in the order of another hash.  The
draw needs nothing but the row and its source's rate, so it is the same at any
partitioning and after any retry.

A mean above ``STEP`` is drawn as the sum of equal smaller ones, each with its
own hash, since the distribution starts at ``exp(-mean)``.

Defined results: a null source is a source of its own; null text has no
characters; sources whose texts are all empty keep the mean 1; repeated rows
draw alike; an input column named like an output column is replaced; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 64.0
_BITS = 48
#: Up to so many sources their rates (about a kilobyte each) are broadcast; beyond, each is joined by shuffle in so many parts.
FEW_SOURCES, SALTS = 5_000, 32


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), from the first 48 bits of an MD5 of the parts joined by colons."""
    joined = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, _BITS // 4), 16, 10).cast("double") / F.lit(float(1 << _BITS))


def mean_rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", text_col: str = "text", epochs: float = 1.0) -> DataFrame:
    """Per source: its mean number of copies a document.  Sources without a weight share what is left equally."""
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("_qm_source")).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0))).cast("double").alias("_qm_size"))
    named = F.coalesce(F.col("_qm_source").isin(list(weights)), F.lit(False))
    total, others, present = sizes.agg(F.sum("_qm_size"), F.sum((~named).cast("int")), F.collect_set(F.when(named, F.col("_qm_source")))).first()
    given = sum(weights[s] for s in present)
    left = max(0.0, 1.0 - sum(weights.values()))
    scale = given + (left if others else 0.0) or 1.0
    share = F.lit((left / others if others else 0.0) / scale)
    for s in sorted(present):
        share = F.when(F.col("_qm_source") == s, weights[s] / scale).otherwise(share)
    return sizes.select("_qm_source", F.when(F.col("_qm_size") > 0, share * F.lit(float(total or 0) * epochs) / F.col("_qm_size")).otherwise(1.0).alias("_qm_mean"))


def with_cdf(rates: DataFrame) -> DataFrame:
    """Adds ``_draws`` and, for the mean of one draw, the distribution function up to where doubles reach 1."""
    rates = rates.withColumn("_qm_draws", F.greatest(F.lit(1), F.ceil(F.col("_qm_mean") / STEP)).cast("int"))
    one = F.col("_qm_mean") / F.col("_qm_draws")
    start = F.struct(F.exp(-one).alias("p"), F.array(F.exp(-one)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * one / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    most = F.ceil(one + F.lit(12.0) * F.sqrt(one) + 20).cast("int")
    return rates.withColumn("_qm_cdf", F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["c"]))


def mix_sources(docs: DataFrame, weights: dict[str, float], seed: int = 17, epochs: float = 1.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The input's columns, with ``copy`` (from 1), ``copies`` and ``shuffle_key``, in the order of the key."""
    docs = docs.drop("copy", "copies", "shuffle_key")
    names = docs.columns
    rates = with_cdf(mean_rates(docs, weights, source_col, text_col, epochs)).select(F.col("_qm_source"), "_qm_draws", "_qm_cdf")
    same = F.col(source_col).cast("string").eqNullSafe(F.col("_qm_source"))
    if docs.select(F.col(source_col)).distinct().limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        rates = F.broadcast(rates)
    else:  # a hot source is many parts
        rates = rates.withColumn("_qm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)) == F.col("_qm_salt")
    joined = docs.join(rates, same)
    seed_text = str(seed)

    def draw(k: Column) -> Column:
        u = uniform(seed_text, F.col(id_col), k)
        return F.size(F.filter("_qm_cdf", lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_qm_draws")), F.lit(0), lambda acc, k: acc + draw(k))
    counted = joined.withColumn("copies", copies).where("copies > 0")
    each = counted.select(*names, "copies", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed_text}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return each.withColumn("shuffle_key", key).orderBy("shuffle_key")
