"""URL expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that are tried on every site, in this order (fixed values).
FEED_PATHS = ("/rss", "/rss.xml", "/feed", "/feed.xml", "/feeds", "/atom", "/atom.xml", "/index.rss", "/index.xml", "/blog/rss", "/blog/feed", "/news/rss", "/news/feed")
#: Schemes whose references are resolved (fixed values); a reference of another one stands as it is.
RELATIVE_SCHEMES = ("", "http", "https", "ftp", "file", "ws", "wss")
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap", "/sitemaps.xml")


def has_scheme(url: Column) -> Column:
    return F.rlike(url, F.lit("^https?://"))


def with_scheme(url: Column, scheme: Column | str = "https://") -> Column:
    return F.when(has_scheme(url), url).otherwise(F.concat(F.lit(scheme) if isinstance(scheme, str) else scheme, url))


def scheme_of(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("https://")), "https://").otherwise("http://")


def host(url: Column) -> Column:
    """Host with port, as it stands in the URL."""
    return F.regexp_extract(url, "://([^/?#]+)", 1)


def on_site(site: Column, path: Column) -> Column:
    """An absolute path on the site of a URL: the path replaces what the URL has."""
    return F.concat(F.regexp_extract(site, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), path)


#: The parts of a reference: scheme, authority, path, query, fragment (RFC 3986, appendix B).
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_ADDRESS = r"\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?|[vV][0-9A-Fa-f]+\..+)\]"


@functools.cache
def _look_alikes() -> str:
    """A pattern of the characters that normalisation (NFKC) turns into delimiters of an authority."""
    found = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if set("/?#@:") & set(unicodedata.normalize("NFKC", c))]
    return "[" + "".join(found) + "]"


def _parts(url: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+", ""), "[\t\r\n]", "")
    names = ("scheme", "host", "path", "query", "fragment")
    return F.struct(*(F.regexp_extract(clean, _PARTS, k + 1).alias(n) for k, n in enumerate(names)))


def _valid(host: Column) -> Column:
    """Brackets hold an address or there are none, and no character passes for a delimiter."""
    bare = ~F.rlike(host, F.lit(r"[\[\]]"))
    return (bare | F.rlike(host, F.lit(f"^(?:[^\\[\\]]*@)?{_ADDRESS}(?::[^\\[\\]]*)?\\z"))) & ~F.rlike(host, F.lit(_look_alikes()))


def _split_params(path: Column) -> tuple[Column, Column]:
    """A path up to the first semicolon of its last segment, and the rest, if that is more than the semicolon."""
    cut = r"(?s)^(.*?)(?:;([^/]*))?\z"
    params = F.regexp_extract(path, cut, 2)
    return F.regexp_extract(path, cut, 1), F.when(params != "", F.concat(F.lit(";"), params)).otherwise("")


def _without_dots(segments: Column) -> Column:
    """Segments after ``.`` and ``..`` have taken effect; one at the end leaves a slash."""
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))
    done = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(done, F.lit(""))).otherwise(done)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _after(base: Column, ref: Column, raw: Column) -> Column:
    """The parts of a reference against those of its base, written out."""
    scheme = F.lower(F.when(ref["scheme"] == "", base["scheme"]).otherwise(ref["scheme"]))
    elsewhere = (scheme != F.lower(base["scheme"])) | ~scheme.isin(*RELATIVE_SCHEMES)
    own_host = ref["host"] != ""
    host_part = F.when(own_host, ref["host"]).otherwise(base["host"])
    folder = F.split(base["path"], "/")
    folder = F.when(F.element_at(folder, -1) != "", F.slice(folder, 1, F.size(folder) - 1)).otherwise(folder)
    # Parameters behind the last segment take no part in dots; an empty list of them goes.
    body, tail = _split_params(ref["path"])
    same_page = (body == "") & (tail == "") & ~own_host
    from_root = F.startswith(body, F.lit("/"))
    whole = F.when(from_root, F.split(body, "/")).otherwise(F.concat(folder, F.split(body, "/")))
    inner = F.filter(whole, lambda s, k: (s != "") | (k == 0) | (k == F.size(whole) - 1))
    joined = F.array_join(_let(F.when(from_root, whole).otherwise(inner), _without_dots), "/")
    joined = F.when(joined == "", "/").otherwise(joined)
    path = F.when(own_host, F.concat(body, tail)).when(same_page, F.concat(*_split_params(base["path"]))).otherwise(F.concat(joined, tail))
    slash = F.startswith(path, F.lit("/"))
    path = F.when((host_part != "") & (path != "") & ~slash, F.concat(F.lit("/"), path)).otherwise(path)
    query = F.when(same_page & (ref["query"] == ""), base["query"]).otherwise(ref["query"])
    marked = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    has_host_mark = (host_part != "") | F.startswith(path, F.lit("//")) | ((scheme != "") & ((path == "") | slash))
    lead = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(has_host_mark, F.concat(F.lit("//"), host_part)).otherwise(""))
    found = F.concat(lead, path, marked("?", query), marked("#", ref["fragment"]))
    return F.when(_valid(base["host"]) & _valid(ref["host"]), F.when(elsewhere, raw).otherwise(found))


def resolve(base: Column | str, ref: Column | str) -> Column:
    """A reference against its base less its last slashes, by the rules of RFC 3986; null if either is missing or is no URL.

    All of it is SQL functions.  Schemes are lower case; empty queries,
    fragments and parameters go; empty segments within a relative path go.
    """
    base, ref = (F.col(c) if isinstance(c, str) else c for c in (base, ref))
    base = F.rtrim(base, F.lit("/"))
    both = F.struct(_parts(base).alias("b"), _parts(ref).alias("r"), ref.alias("raw"))
    return F.when(ref == "", base).when(base == "", ref).otherwise(_let(both, lambda x: _after(x["b"], x["r"], x["raw"])))
