"""Article text and feed links from HTML.

The standard library's tokenizer feeds a small tree.  Recovery rules: void
elements never nest; ``p``, ``li`` and table parts close a like one that is
still open in the same block; an end tag without a start is ignored; what is
open at the end is closed.  The work is in proportion to the page, whatever its
tags: ends are found by the depths at which names are open, and texts are
stretches of one list of strings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources.schema import FOUND_LINK

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": "p", "li": "li", "tr": "tr", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

#: What is dropped, where articles are looked for and in which order, and the limits of length.
DROP_TAGS = ("nav", "header", "footer", "aside", "form", "button")
DROP_SELECTORS = (".sidebar", ".navigation", ".menu", ".advertisement", ".ads", "#header", "#footer", "#comments", ".social-share", ".related-posts", ".recommended", ".newsletter", ".popup")
ARTICLE_SELECTORS = (
    "article", '[role="main"] article', "main article", ".post-content", ".entry-content", ".article-content", ".article__body", ".story-content", ".content-body", ".article-text", ".post-body",
    ".content", "#content", ".post", ".article-body", ".story-body", '[itemprop="articleBody"]', ".field-name-body", ".node-content", ".entry", ".single-content",
)
TEXT_TAGS = frozenset(("p", *HEADINGS, "blockquote", "li"))
_PARAGRAPH = frozenset(("p",))
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml", "application/feed+json", "text/xml")
#: Starts of tags without an end that the tokenizer gets.
MAX_UNENDED = 50
MIN_BLOCK, MIN_ARTICLE, MIN_PARAGRAPH, MIN_RUN, MIN_TEXT = 30, 200, 50, 3, 500


class Node:
    """``inside``: which of ``ABOVE`` an element around this one meets."""

    __slots__ = ("tag", "attrs", "children", "inside")

    def __init__(self, tag: str, attrs: dict[str, str], inside: frozenset[str] = frozenset()):
        self.tag, self.attrs, self.inside, self.children = tag, attrs, inside, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack.extend(reversed(x.children))
            else:
                yield x

    def text(self) -> str:
        """Text nodes, each stripped, put together."""
        return "".join(s.strip() for s in self.strings())

    def texts(self, tags: frozenset[str]) -> Iterator[tuple[str, str]]:
        """Tag and text (text nodes, each stripped, put together) of the elements below with these tags, in document order.

        Strings are gathered once: an element's text is a stretch of them.
        """
        pieces: list[str] = []
        spans: list[list] = []
        stack: list = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag in tags:
                    spans.append([x.tag, len(pieces), 0])
                    stack.append(spans[-1])  # closes the stretch
                stack.extend(reversed(x.children))
            elif isinstance(x, list):
                x[2] = len(pieces)
            elif x := x.strip():
                pieces.append(x)
        for tag, start, end in spans:
            yield tag, "".join(pieces[start:end])

    def drop(self, test: Callable[[Node], bool]) -> None:
        """Takes out the elements below that meet the test."""
        stack = [self]
        while stack:
            node = stack.pop()
            node.children = [c for c in node.children if not (isinstance(c, Node) and test(c))]
            stack.extend(c for c in node.children if isinstance(c, Node))

    def names(self) -> Iterator[str]:
        """Simple selectors that the element meets."""
        yield self.tag
        for c in self.attrs.get("class", "").split():
            yield f".{c}"
        if "id" in self.attrs:
            yield f"#{self.attrs['id']}"
        for a in ("role", "itemprop"):
            if a in self.attrs:
                yield f'[{a}="{self.attrs[a]}"]'


#: Parts of selectors that stand before another.
ABOVE = frozenset(x for s in ARTICLE_SELECTORS for x in s.split()[:-1])
_DROPPED = frozenset(DROP_SELECTORS)


class _Builder(HTMLParser):
    """Keeps the depths at which each name is open, so that no tag makes it climb past elements that stay open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.path = [self.root]
        self.open: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def close_to(self, depth: int) -> None:
        """Ends the elements from this depth on."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.open[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = CLOSES.get(tag, "p" if tag in BLOCKS else "").split()
        if depth := max((self.open[e][-1] for e in ends if self.open[e]), default=0):
            if not self.blocks or depth >= self.blocks[-1]:
                self.close_to(depth)
        above = self.path[-1]
        met = ABOVE.intersection(above.names()) if len(self.path) > 1 else frozenset()
        node = Node(tag, {k: v or "" for k, v in attrs}, above.inside | met if met else above.inside)
        above.children.append(node)
        if tag not in VOID:
            self.open[tag].append(len(self.path))
            if tag in BLOCKS:
                self.blocks.append(len(self.path))
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            self.close_to(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)


def read[P: HTMLParser](parser: P, html: str) -> P:
    """Feeds a page to a parser; markup that the tokenizer can't read ends it, and what came before is kept.

    Behind the last ``>`` no tag ends.  The tokenizer would look for the end of each, so many starts there are text.
    """
    cut = html.rfind(">") + 1
    rest = html[cut:] if html.count("<", cut) > MAX_UNENDED else ""
    try:
        parser.feed(html[: len(html) - len(rest)])
        parser.close()
        if rest:
            parser.handle_data(unescape(rest))
    except (AssertionError, ValueError, IndexError):
        pass
    return parser


def parse(html: str) -> Node:
    """The page's tree."""
    return read(_Builder(), html).root


def first_matches(root: Node, selectors: tuple[str, ...]) -> list[Node]:
    """The first element of each selector that has one, in the order of the selectors, from one walk."""
    by_name: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for k, s in enumerate(selectors):
        *above, own = s.split()
        by_name[own].append((k, above[0] if above else ""))
    found: dict[int, Node] = {}
    for node in root.walk():
        for name in node.names():
            for k, above in by_name.get(name, ()):
                if k not in found and (not above or above in node.inside):
                    found[k] = node
        if len(found) == len(selectors):
            break
    return [found[k] for k in sorted(found)]


def paragraph_runs(paragraphs: list[str]) -> list[str]:
    """Paragraphs that stand in a run of at least ``MIN_RUN`` long ones."""
    kept: list[str] = []
    run: list[str] = []
    for p in [*paragraphs, ""]:
        if len(p) > MIN_PARAGRAPH:
            run.append(p)
            continue
        if len(run) >= MIN_RUN:
            kept += run
        run = []
    return kept


def article_text(html: str | None) -> str | None:
    """The article's text, or None if the page has nothing like one."""
    if not html:
        return None
    root = parse(html)
    root.drop(lambda n: n.tag in ("script", "style") or n.tag in DROP_TAGS or (bool(n.attrs) and not _DROPPED.isdisjoint(n.names())))
    for found in first_matches(root, ARTICLE_SELECTORS):
        found.drop(lambda n: n.tag in ("script", "style", "noscript"))
        blocks = [f"\n{text}\n" if tag in HEADINGS else text for tag, text in found.texts(TEXT_TAGS) if len(text) > MIN_BLOCK]
        if len("\n".join(blocks)) > MIN_ARTICLE:
            return "\n\n".join(blocks)
    if kept := paragraph_runs([text for _, text in root.texts(_PARAGRAPH)]):
        return "\n\n".join(kept)
    lines = [x for x in (s.strip() for s in "\n".join(root.strings()).split("\n")) if len(x) > MIN_PARAGRAPH]
    text = "\n".join(lines)
    return text if len(text) > MIN_TEXT else None


def joined(base: str, ref: str) -> str | None:
    """A link against its page, as :func:`quillmill.functions.urls.resolve` does it for columns; None if it is no URL."""
    try:
        return urljoin(base.rstrip("/"), ref)
    except ValueError:
        return None


class _Links(HTMLParser):
    """The attributes of the ``link`` elements, in document order; the rest of the page is passed over, not kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "link":
            self.found.append({k: v or "" for k, v in attrs})

    def handle_data(self, data: str) -> None:
        pass


def feed_links(base: str, html: str | None) -> list[dict[str, str]]:
    """Feeds that a page links to, by type in the fixed order; alternates of these types are among them."""
    by_type: dict[str, list[dict[str, str]]] = {kind: [] for kind in FEED_TYPES}
    for a in read(_Links(), html or "").found:
        kind, href = a.get("type"), a.get("href")
        if kind in by_type and href and (url := joined(base, href)):
            by_type[kind].append({"url": url, "title": a.get("title", ""), "type": kind})
    return [x for found in by_type.values() for x in found]


@F.pandas_udf(T.StringType())
def extract_article(pages: pd.Series) -> pd.Series:
    return pages.map(article_text)


@F.pandas_udf(T.ArrayType(FOUND_LINK))
def discover_links(base: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([feed_links(b or "", h) for b, h in zip(base, pages)])
