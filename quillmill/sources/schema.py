"""Declared schemas of the domain tables and of records in flight; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

FEED_TYPES = {"RSS": "RSS Feed", "ATOM": "Atom Feed", "SITEMAP": "Sitemap"}
MAX_URL, MAX_TITLE = 2048, 500
ERROR_LIMIT = 5


def _table(spec: str) -> T.StructType:
    """``name type`` pairs; a trailing ``?`` marks a nullable column."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType()}
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


WEBSITE = _table("id long, url string, name string, active boolean, created_at timestamp, updated_at timestamp")
FEED = _table("id long, website_id long, feed_url string, feed_type string, title string, description string, last_checked timestamp?, last_success timestamp?, active boolean, error_count int, last_error string, created_at timestamp, updated_at timestamp")
ARTICLE = _table("id long, feed_id long, title string, url string, content string, summary string, author string, published_date timestamp?, retrieved_at timestamp, updated_at timestamp, content_hash string, raw_data string")
ARTICLE_FEEDS = _table("article_id long, feed_id long")
VISIT_LOG = _table("id long, feed_id long, started_at timestamp, completed_at timestamp?, success boolean, new_articles int, updated_articles int, error_message string")
#: What was retrieved, as a table: parsers read it, nothing here does network I/O.
RAW_DOCUMENT = _table("url string, status int?, content_type string?, body string?, error string?, retrieved_at timestamp?")

def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_TEXTS = T.ArrayType(T.StringType())
ENTRY = T.StructType([*_strings("url", "title", "content", "summary", "author"), T.StructField("published_date", T.TimestampNTZType()), T.StructField("tags", _TEXTS), *_strings("raw_data")])
FEED_RESULT = T.StructType([T.StructField("success", T.BooleanType()), *_strings("kind", "title", "description", "link", "language"), T.StructField("entries", T.ArrayType(ENTRY)), *_strings("error")])
FOUND_LINK = T.StructType(_strings("url", "title", "type"))
SITEMAP_RESULT = T.StructType([T.StructField("pages", _TEXTS), T.StructField("children", _TEXTS), *_strings("error")])
#: Rows of a list of feeds given as JSON.
MULTI_FEED = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))
