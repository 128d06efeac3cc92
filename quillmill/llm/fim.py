"""Fill-in-middle: texts cut in three and put in an order in which the middle comes last.

A text's units are its code points.  Two numbers from a hash of seed and id
cut them into prefix, middle and suffix, a third leaves some texts as they are
(``plain``), and a fourth picks the order of the others: ``psm`` is
``<P>prefix<S>suffix<M>middle`` and ``spm`` is ``<S>suffix<P>prefix<M>middle``.
A text that holds a sentinel stays plain, so the sentinels of an output tell
its parts apart and the text can be rebuilt.

Everything is a SQL expression over one row: nothing is shuffled and no Python
runs on executors.

Defined results: null text is empty text; an empty text is plain; a null id
hashes as the word ``null``; repeated rows come out alike; an input column
named like an output column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ANY = "<[PSM]>"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def hash_numbers(seed: str, id_col: str, many: int) -> list[Column]:
    """Unsigned integers from the first groups of eight digits of the hex SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(many)]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    ahead = docs.withColumn("_qm_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    ahead = ahead.withColumn("_qm_units", F.regexp_extract_all("_qm_text", F.lit("(?s)."), F.lit(0))).withColumn("_qm_n", F.size("_qm_units"))
    h1, h2, h3, h4 = hash_numbers(seed, id_col, 4)
    plain = (F.col("_qm_n") == 0) | F.col("_qm_text").rlike(_ANY) | (h3 % 100 >= 100 - plain_percent)
    cut = lambda h: (h % (F.col("_qm_n") + 1)).cast("int")
    rows = ahead.withColumns({"_qm_form": F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"), "_qm_a": F.least(cut(h1), cut(h2)), "_qm_b": F.greatest(cut(h1), cut(h2))})
    units = F.col("_qm_units")
    part = lambda x, y: F.array_join(F.slice(units, x + 1, y - x), "")
    prefix, middle, suffix = part(F.lit(0), F.col("_qm_a")), part(F.col("_qm_a"), F.col("_qm_b")), part(F.col("_qm_b"), F.col("_qm_n"))
    moved = F.col("_qm_form") != "plain"
    pieces = [F.when(F.col("_qm_form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix)), F.lit(MIDDLE), middle]
    return rows.select(
        *own,
        F.col("_qm_n").cast("long").alias("n"),
        F.col("_qm_form").alias("form"),
        F.when(moved, F.col("_qm_a").cast("long")).alias("prefix_chars"),
        F.when(moved, (F.col("_qm_b") - F.col("_qm_a")).cast("long")).alias("middle_chars"),
        F.when(moved, F.concat(*pieces)).otherwise(F.col("_qm_text")).alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from an output and its form alone: the parts between sentinels, in their first order."""
    parts = F.split(output, _ANY, -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))
