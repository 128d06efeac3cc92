"""Text expressions, all built from SQL functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.sources.schema import FEED_TYPES


def moment(at: datetime | Column) -> Column:
    """A time, given or worked out by a query, as the tables' timestamps are."""
    return F.lit(at).cast("timestamp_ntz")


def blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def contains_ci(c: Column, q: str) -> Column:
    """Literal, case-insensitive substring test."""
    return F.contains(F.lower(c), F.lit(q.lower()))


def contains_plain(c: Column, q: str) -> Column:
    """As ``contains_ci``, and accents don't count."""
    return F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(q), "UNICODE_CI_AI"))


def content_hash(title: Column, content: Column, summary: Column) -> Column:
    return F.sha2(F.concat(*(F.coalesce(c, F.lit("")) for c in (title, content, summary))), 256)


def stored_hash(title: Column, content: Column, summary: Column) -> Column:
    """The hash as saved: none while there is no content."""
    return F.when(blank(content), "").otherwise(content_hash(title, content, summary))


def title_case(c: Column) -> Column:
    """Upper case after every character that has no case, lower case elsewhere."""
    pieces = F.split(c, r"(?<=[^\p{IsUppercase}\p{IsLowercase}\p{Lt}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def slug_title(url: Column) -> Column:
    """Title from the last path segment of a URL (the one before a final slash)."""
    parts = F.split(url, "/")
    last = F.when(F.endswith(url, F.lit("/")), F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(-1)))
    return first_filled(title_case(F.regexp_replace(F.coalesce(last, F.lit("")), "-", " ")), url)


def repaired_title(title: Column, url: Column) -> Column:
    """A title that is only the URL, or holds a slash, is made anew from the URL."""
    last = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    new = F.substring(title_case(F.regexp_replace(last, "-", " ")), 1, 500)
    return F.when((title == url) | F.contains(title, F.lit("/")), new).otherwise(title)


def clip(c: Column, n: int, tail: str = "...") -> Column:
    """At most ``n`` characters; a longer text ends in ``tail``."""
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n - len(tail))), F.lit(tail))).otherwise(c)


def display_title(title: Column, url: Column, width: int | None = None) -> Column:
    return first_filled(title, url if width is None else F.left(url, F.lit(width)))


def minute(c: Column, never: str = "Never") -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(never))


def feed_label(kind: Column) -> Column:
    label = kind
    for code, text in FEED_TYPES.items():
        label = F.when(kind == code, text).otherwise(label)
    return label


def feed_type_from(url: Column, mime: Column) -> Column:
    """Feed type as URL and MIME type suggest it."""
    url, mime = F.lower(url), F.lower(mime)
    return F.when(F.contains(url, F.lit("atom")) | F.contains(mime, F.lit("atom")), "ATOM").when(F.contains(url, F.lit("sitemap")), "SITEMAP").otherwise("RSS")


def known_type(kind: Column) -> Column:
    kind = F.upper(kind)
    return F.when(kind.isin(*FEED_TYPES), kind).otherwise("RSS")


def status_text(errors: Column, last_success: Column) -> Column:
    return F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" errors"))).when(last_success.isNotNull(), "OK").otherwise("-")


def duration_text(start: Column, end: Column) -> Column:
    """Seconds with one decimal; ``-`` while open."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(end.isNull(), "-").otherwise(F.format_string("%.1fs", micros / 1e6))


def html_like(content_type: Column) -> Column:
    kind = F.lower(content_type)
    return F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml"))
