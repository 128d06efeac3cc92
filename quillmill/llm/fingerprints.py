"""Order-independent document fingerprints: a homomorphic multiset hash.

A paragraph (a line of the text) hashes to a wide vector, and a text's
fingerprint is the sum of its paragraphs' vectors, so paragraphs may move and
may be added or taken away with one sum.  The vector has two parts:

* ``WHOLE`` lanes modulo 2^32, all cut from one SHA-256 of the paragraph: they
  decide equality;
* ``LANES`` signed lanes modulo 2^32: the paragraph itself and each four words
  in a row of its sentences add or take 1 at one of them, both by their hash.

The likeness of two fingerprints is 1 if they are equal, else the cosine of
their signed lanes, which estimates that of the multisets of stretches with a
standard error of about ``1 / sqrt(LANES)`` at any length of the texts.
Everything on the main path is a SQL expression; no Python runs on executors.

Defined results: null text is empty text; two empty texts are alike; the last
document is followed by the first; repeated ids follow each other in the order
of their texts; null ids come last; a lone document follows itself; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import id_bounds, with_range
from .scratch import shuffle_width

WHOLE, LANES = 8, 256
#: Four words with one space between them, in sentences that end at line ends.
STRETCH = r"[^ \n]+(?: [^ \n]+){3}"
_MASK = (1 << 32) - 1


def _number(text: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(text, at, n), 16, 10).cast("long")


def _add(acc: Column, x: Column) -> Column:
    return (acc + x).bitwiseAND(F.lit(_MASK).cast("long"))


def with_vector(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, the ``array<bigint>`` of ``WHOLE + LANES`` sums of column ``text``.

    The hashes are columns of their own, each used by many lanes, so they are
    worked out once a row.  A lane is counted from one sort: stretches as odd
    numbers among even marks, two a lane (added and taken), so the places of
    the marks tell how many stretches lie between them.
    """
    zero = F.lit(0).cast("long")
    sentences = F.regexp_replace(text, r"([.!?]) ", "$1\n")
    code = lambda s: F.pmod(F.conv(F.substring(F.md5(s), 1, 4), 16, 10).cast("int"), F.lit(2 * LANES)) * 2 + 1
    marks = F.sequence(F.lit(0), F.lit(4 * LANES), F.lit(2))
    rows = rows.withColumns({
        "_lines": F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, "\n", -1), lambda x: F.sha2(x, 256))),
        "_parts": F.sort_array(F.concat(marks, F.transform(F.concat(F.regexp_extract_all(sentences, F.lit(STRETCH), F.lit(0)), F.filter(F.split(text, "\n", -1), lambda x: x != "")), code))),
    })
    rows = rows.withColumn("_marks", F.filter(F.transform("_parts", lambda x, i: F.when(x.bitwiseAND(1) == 0, i)), lambda i: i.isNotNull()))

    def whole(k: int) -> Column:
        return F.aggregate("_lines", zero, lambda acc, h: _add(acc, _number(h, 8 * k + 1, 8)))

    def lane(k: Column) -> Column:
        at = lambda j: F.get("_marks", 2 * k + j).cast("long")
        return _add(at(1) * 2, -at(0) - at(2))

    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane)
    return rows.withColumn(name, F.concat(F.array(*map(whole, range(WHOLE))), lanes)).drop("_lines", "_parts", "_marks")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the union (or, with ``sign`` -1, the difference) of two texts' paragraphs."""
    return F.zip_with(a, b, lambda x, y: _add(x, sign * y))


def as_text(v: Column) -> Column:
    """Fixed-width hex of a vector."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _signed(x: Column) -> Column:
    return x - F.shiftleft(F.shiftright(x, 31), 32)


def _product(a: Column, b: Column) -> Column:
    """Sum of products of the signed lanes."""
    lanes = lambda v: F.slice(v, WHOLE + 1, LANES)
    return F.aggregate(F.zip_with(lanes(a), lanes(b), lambda x, y: _signed(x) * _signed(y)), F.lit(0).cast("long"), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two vectors."""
    size = F.sqrt(_product(a, a).cast("double") * _product(b, b).cast("double"))
    near = F.try_divide(_product(a, b).cast("double"), size)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(near, F.lit(0.0)))))


def with_next(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``_next``: ``value`` of the next row in descending ``doc_id``; the last row gets the first's.

    Ids are cut into ranges at ids that exist.  A range also gets a copy of
    the row that follows its last one (the bound below it, or the greatest id
    for the lowest range), so one shuffle by range is enough.
    """
    spark = rows.sparkSession
    ranges = 4 * shuffle_width(spark)
    bounds, high = id_bounds(rows, "doc_id", ranges)
    rows = with_range(rows, "doc_id", bounds, "_range")
    bound = F.get(F.lit(bounds or [None]).cast("array<bigint>"), F.col("_range"))
    nothing = F.lit(None).cast("int")
    below = F.when(F.col("doc_id") == bound, F.col("_range") + 1).otherwise(nothing)
    around = F.when(F.col("doc_id") == F.lit(high).cast("long"), F.lit(0)).otherwise(nothing)
    if high is None:  # null ids only
        around = F.lit(0)
    places = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("ghost")), F.struct(below.alias("r"), F.lit(1).alias("ghost")), F.struct(around.alias("r"), F.lit(2).alias("ghost")))
    dealt = rows.select(*[c for c in rows.columns if c != "_range"], F.explode(F.filter(places, lambda p: p["r"].isNotNull())).alias("_p")).select("*", F.col("_p.r").alias("_r"), F.col("_p.ghost").alias("_ghost")).drop("_p")
    w = Window.partitionBy("_r").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), value)
    return dealt.withColumn("_next", F.lead(value).over(w)).where("_ghost = 0").drop("_r", "_ghost")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_vector(rows, "text", "_v")
    both = with_next(rows.select("doc_id", F.struct("text", "_v").alias("_row")), "_row")
    n = F.char_length("_row.text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_row.text"), F.lit(1), n - cut), F.substring(F.col("_next.text"), F.lit(1), cut))
    made = with_vector(both.select("doc_id", n.cast("long").alias("n_chars"), F.col("_row._v").alias("_v"), F.col("_next._v").alias("_n"), edited.alias("_edited")), "_edited", "_e")
    return made.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(F.col("_v")).alias("fingerprint"), as_text(F.col("_e")).alias("edited_fingerprint"), likeness(F.col("_v"), F.col("_e")).alias("near_edited"), likeness(F.col("_v"), F.col("_n")).alias("near_next"))
