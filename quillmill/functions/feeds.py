"""RSS, Atom and sitemap documents.

Documents that are well formed are read at once; for others a pull parser
keeps what is complete before the error, so a truncated feed gives its first
entries and not a failed job.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree.ElementTree import Element, ParseError, XMLPullParser, fromstring

import pandas as pd
from pyspark.sql import functions as F

from quillmill.sources.schema import FEED_RESULT, SITEMAP_RESULT

ATOM_NS = "http://www.w3.org/2005/Atom"
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


_as_json = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode
_ISO = re.compile(r"\d{4}-\d\d-\d\dT\S*\Z")


@functools.lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _text(node: Element) -> str:
    return ("".join(node.itertext()) if len(node) else node.text or "").strip()


def _elements(body: str) -> tuple[list[tuple[Element, Element | None]], str, str | None]:
    """Finished elements with their parents, in order of their ends; the root's tag; and the error that stopped the parser."""
    done: list[tuple[Element, Element | None]] = []
    try:
        whole = fromstring(body)
    except ParseError:
        return _until_error(body)
    todo: list[tuple[Element, Element | None]] = [(whole, None)]
    while todo:
        node, parent = todo.pop()
        done.append((node, parent))
        if len(node):
            todo.extend([(c, node) for c in node])
    done.reverse()  # each element before its later siblings and its parent
    return done, whole.tag, None


def _until_error(body: str) -> tuple[list[tuple[Element, Element | None]], str, str | None]:
    parser, error, path, root = XMLPullParser(("start", "end")), None, [], ""
    done: list[tuple[Element, Element | None]] = []
    try:
        parser.feed(body)
        parser.close()
    except ParseError as e:
        error = str(e)
    try:
        for event, node in parser.read_events():
            if event == "start":
                root = root or node.tag
                path.append(node)
            else:
                path.pop()
                done.append((node, path[-1] if path else None))
    except ParseError as e:
        error = str(e)
    return done, root, error


def when(text: str | None) -> datetime | None:
    """A date of RFC 822 or ISO 8601 in UTC; None if it is neither."""
    if not text:
        return None
    text = text.strip()
    # What looks like ISO 8601 is never a date of RFC 822, which has blanks.
    for read in (datetime.fromisoformat,) if _ISO.match(text) else (parsedate_to_datetime, datetime.fromisoformat):
        try:
            t = read(text)
            return (t.astimezone(UTC) if t.tzinfo else t).replace(tzinfo=None, microsecond=0)
        except (ValueError, TypeError, IndexError, OverflowError):
            continue
    return None


def entry(node: Element, raw: bool = True) -> dict | None:
    """One article record; None without a link and an id.  ``raw`` says whether it holds all fields as JSON too."""
    kids: dict[str, list[tuple[Element, str]]] = {}
    for c in node:
        kids.setdefault(_local(c.tag), []).append((c, _text(c)))

    def first(*names: str) -> str | None:
        return next((kids[n][0][1] for n in names if n in kids), None)

    links = kids.get("link", ())
    url = next((href for c, _ in links if (href := c.get("href")) and c.get("rel", "alternate") == "alternate"), None) or next((t for _, t in links if t), None) or first("guid", "id")
    if not url:
        return None
    title, summary = first("title"), first("description", "summary") or ""
    content = next((t for n in ("encoded", "content") for _, t in kids.get(n, ()) if t), summary)
    names = [next((_text(x) for x in c if _local(x.tag) == "name"), t) for n in ("author", "creator") for c, t in kids.get(n, ())]
    # A published date that can't be read does not fall back to the updated one.
    date = first("pubdate", "published", "date")
    tags = [tag for c, t in kids.get("category", ()) if (tag := c.get("term") or t)]
    found = {"url": url, "title": "Untitled" if title is None else title, "content": content, "summary": summary, "author": ", ".join(filter(None, names)), "published_date": when(first("updated") if date is None else date), "tags": tags}
    return found | {"raw_data": _as_json({n: [t for _, t in cs] for n, cs in kids.items()}) if raw else None}


def parse_feed(body: str | None, raw: bool = True) -> dict:
    """Kind, description and entries of a feed document."""
    empty = {"success": False, "kind": "RSS", "title": "", "description": "", "link": "", "language": "", "entries": [], "error": "empty document"}
    if not body:
        return empty
    done, root, error = _elements(body)
    entries, about, atom = [], {}, root == f"{{{ATOM_NS}}}feed"
    for node, parent in done:
        name = _local(node.tag)
        if name in ("item", "entry"):
            atom = atom or name == "entry"
            if found := entry(node, raw):
                entries.append(found)
        elif name in ("title", "description", "subtitle", "link", "language") and parent is not None and _local(parent.tag) in ("channel", "feed", "rdf"):
            value = node.get("href") or _text(node)
            about.setdefault("description" if name == "subtitle" else name, value)
    return {"success": bool(entries or about), "kind": "ATOM" if atom else "RSS", "entries": entries, "error": error, **{k: about.get(k, "") for k in ("title", "description", "link", "language")}}


#: Characters of a sitemap that the parser gets at once.
PIECE = 1 << 16


def sitemap_locs(body: str | None, namespaced: bool = False) -> tuple[list[str], list[str], str | None]:
    """Page URLs and child sitemaps in order; with ``namespaced`` only elements of the sitemap namespace count.

    What the root holds is let go as it ends, so a long sitemap is never a whole tree.
    """
    pages: list[str] = []
    children: list[str] = []
    if not body:
        return pages, children, "empty document"
    kinds = {"url": pages, "sitemap": children}
    parser, path = XMLPullParser(("start", "end")), []

    def take() -> None:
        for event, node in parser.read_events():
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if path and _local(node.tag) == "loc":
                tag = path[-1].tag
                if (found := kinds.get(_local(tag))) is not None and (not namespaced or tag.startswith(f"{{{SITEMAP_NS}}}")) and (text := _text(node)):
                    found.append(text)
            if len(path) == 1:
                path[0].clear()

    error = None
    try:
        for at in range(0, len(body), PIECE):
            parser.feed(body[at : at + PIECE])
            take()
        parser.close()
    except ParseError as e:
        error = str(e)
    try:
        take()
    except ParseError as e:
        error = str(e)
    return pages, children, error


#: Characters of documents whose results a worker holds at once; one longer document goes alone.
HELD = 1 << 20


def _in_pieces(bodies: Iterator[pd.Series], read: Callable[[str | None], object], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Results in frames of few documents, so that what a worker holds does not grow with Spark's batch."""
    for body in bodies:
        made, size = [], 0
        for text in body:
            made.append(read(text))
            size += len(text or "")
            if size >= HELD:
                yield pd.DataFrame(made, columns=columns)
                made, size = [], 0
        if made:
            yield pd.DataFrame(made, columns=columns)


_FEED = ["success", "kind", "title", "description", "link", "language", "entries", "error"]
_SITEMAP = ["pages", "children", "error"]


@F.pandas_udf(FEED_RESULT)
def parse_feeds(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    return _in_pieces(bodies, parse_feed, _FEED)


@F.pandas_udf(FEED_RESULT)
def parse_feeds_lean(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Without the JSON of each entry, which is null."""
    return _in_pieces(bodies, functools.partial(parse_feed, raw=False), _FEED)


@F.pandas_udf(SITEMAP_RESULT)
def parse_sitemaps(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    return _in_pieces(bodies, sitemap_locs, _SITEMAP)


@F.pandas_udf(SITEMAP_RESULT)
def parse_sitemaps_ns(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    return _in_pieces(bodies, functools.partial(sitemap_locs, namespaced=True), _SITEMAP)
