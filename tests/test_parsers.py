from datetime import datetime

import pytest

from quillmill.functions import feeds, html
from quillmill.operators import discover

LONG = "x" * 60
RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<title>Chan</title><description>About</description><link>https://s.example.com/</link><language>en</language>
<item><title>One</title><link>https://s.example.com/1</link><description>Sum</description><content:encoded> </content:encoded><content:encoded>Body</content:encoded>
<dc:creator>Ann</dc:creator><dc:creator></dc:creator><dc:creator>Bob</dc:creator><category>a</category><category></category><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate></item>
<item><guid>https://s.example.com/2</guid><title></title><description>Only summary</description></item>
<item><title>No address</title></item>
<item><link>https://s.example.com/3</link><pubDate>soon</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><subtitle>B</subtitle><entry><title>E</title><link rel="self" href="https://x/self"/><link href="https://x/e"/>
<author><name>Ann</name></author><updated>2024-02-03T04:05:06Z</updated><category term="t"/><summary>s</summary></entry></feed>"""


def test_rss():
    got = feeds.parse_feed(RSS)
    one, two, three = got["entries"]
    assert (got["title"], got["description"], got["kind"], got["language"]) == ("Chan", "About", "RSS", "en")
    assert (one["content"], one["author"], one["tags"], one["published_date"]) == ("Body", "Ann, Bob", ["a"], datetime(2024, 1, 1, 9))
    assert (two["url"], two["title"], two["content"]) == ("https://s.example.com/2", "", "Only summary")
    assert (three["title"], three["published_date"]) == ("Untitled", None)


def test_atom():
    got = feeds.parse_feed(ATOM)
    entry = got["entries"][0]
    assert (got["kind"], got["description"], entry["url"], entry["author"], entry["tags"]) == ("ATOM", "B", "https://x/e", "Ann", ["t"])
    assert entry["published_date"] == datetime(2024, 2, 3, 4, 5, 6)


def test_broken_documents():
    cut = feeds.parse_feed(RSS[: RSS.index("<item><guid>")] + "<item><title>half")
    assert len(cut["entries"]) == 1 and cut["success"] and cut["error"]
    assert not feeds.parse_feed("not xml")["success"] and not feeds.parse_feed(None)["success"]


def test_sitemaps():
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    assert feeds.sitemap_locs(f"<urlset {ns}><url><loc> a </loc></url><url><loc>a</loc></url></urlset>", True)[:2] == (["a", "a"], [])
    plain = "<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>"
    assert feeds.sitemap_locs(plain)[1] == ["c"] and feeds.sitemap_locs(plain, True)[1] == []


SITEMAPS = (
    "<urlset><url><loc> a<b>c</b> </loc><loc/><x><loc>no</loc></x></url><sitemap><loc>m</loc></sitemap><url><loc>z</loc>", "<url><loc>a</loc><loc>b</loc></url>", "<loc>a</loc>", "", "<urlset><url><loc>a</loc></url></urlset>x", "no", "<urlset><url><loc>a</url>",
    "<s:urlset xmlns:s='http://www.sitemaps.org/schemas/sitemap/0.9'><s:url><s:loc>a</s:loc></s:url><url><s:loc>b</s:loc></url></s:urlset>", "<?xml version='1.0' encoding='latin-1'?><urlset><URL><Loc>\u00e9&amp;\U0001f600</Loc></URL></urlset>",
)


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
@pytest.mark.parametrize("namespaced", [False, True])
def test_sitemaps_in_pieces_are_read_as_whole_trees(monkeypatch, piece, namespaced):
    monkeypatch.setattr(feeds, "PIECE", piece)
    for body in SITEMAPS:
        done, _, error = feeds._elements(body) if body else ([], "", "empty document")
        locs = [(feeds._local(p.tag), feeds._text(n)) for n, p in done if feeds._local(n.tag) == "loc" and p is not None and (not namespaced or p.tag.startswith(f"{{{feeds.SITEMAP_NS}}}"))]
        want = [[x for kind, x in locs if x and kind == name] for name in ("url", "sitemap")]
        assert feeds.sitemap_locs(body, namespaced) == (*want, error), body


def test_a_long_sitemap_is_never_a_whole_tree():
    import tracemalloc

    body = "<sitemapindex>" + "".join(f"<sitemap><loc>https://s.example.com/{k:09d}</loc></sitemap>" for k in range(40_000)) + "</sitemapindex>"
    tracemalloc.start()
    _, children, error = feeds.sitemap_locs(body)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(children) == 40_000 and error is None and peak < 8_000_000


def test_documents_of_a_large_batch_are_read_in_pieces(spark):
    import pandas as pd

    bodies = pd.Series([*["<rss><channel><title>" + "x" * 300_000 + f"{k}</title></channel></rss>" for k in range(20)], None, ""])
    frames = list(feeds.parse_feeds_lean.func(iter([bodies, bodies[:0], bodies[:1]])))
    assert max(map(len, frames)) == 4 and sum(map(len, frames)) == 23
    assert [t[-2:].strip("x") for f in frames for t in f["title"]] == [*map(str, range(20)), "", "", "0"]


def test_sitemap_levels(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *c: f"<sitemapindex {ns}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in c) + "</sitemapindex>"
    raw = spark.createDataFrame([("r", index("a", "b", "gone")), ("a", index("deep", "r")), ("b", f"<urlset {ns}><url><loc>p</loc></url></urlset>"), ("deep", f"<urlset {ns}><url><loc>q</loc></url></urlset>"), ("bad", "<urlset")], "url string, body string")
    roots = spark.createDataFrame([("r",), ("bad",)], "url string")
    got = sorted(tuple(r) for r in discover.expand_sitemaps(roots, raw).collect())
    assert got == [("bad", "bad", "Sitemap"), ("r", "b", "Sitemap (1 URLs)"), ("r", "deep", "Sitemap"), ("r", "gone", "Sitemap (unreachable)"), ("r", "r", "Sitemap")]
    assert sorted(tuple(r) for r in discover.sitemap_pages(roots, raw).collect()) == [("r", "p"), ("r", "q")]


def test_article_selectors_and_fallbacks():
    p = "".join(f"<p>{LONG}{k}</p>" for k in range(4))
    assert html.article_text(f"<body><nav><p>{LONG}</p></nav><div class='post-content'>{p}</div></body>").count("\n\n") == 3
    # A first match that is too short gives way to a later selector.
    got = html.article_text(f"<article><p>{LONG}</p></article><div id=content><h2>{LONG}</h2>{p}</div>")
    assert got.startswith("\n" + LONG) and got.count(LONG) == 5
    nested = html.article_text(f"<article><ul><li><p>{LONG}</p></li></ul>{p}</article>")
    assert nested.count(LONG) == 6  # the list item and its paragraph both count
    runs = html.article_text(f"<p>{LONG}a<p>{LONG}b<p>short<p>{LONG}c<p>{LONG}d<p>{LONG}e")
    assert runs == "\n\n".join(LONG + c for c in "cde")
    lines = html.article_text("<div>" + "<br>".join(f"{LONG * 2}{k}\n" for k in range(5)) + "</div>")
    assert lines and len(lines) > 500
    assert html.article_text("<p>nothing</p>") is None and html.article_text(None) is None


def test_inline_tags_join_without_a_space():
    assert html.parse("<p>foo <b>bar</b> baz</p>").text() == "foobarbaz"


def test_links_of_a_home_page():
    page = """<link rel="alternate" type="application/atom+xml" title="A" href="/a"><link type="application/rss+xml" href="r">
    <link rel="alternate" type="application/rss+xml"><link rel="alternate" type="text/html" href="/x"><link rel="alternate" type="application/atom+xml" title="A" href="/a">"""
    got = html.feed_links("https://s.example.com/", page)
    assert [x["url"] for x in got] == ["https://s.example.com/r", "https://s.example.com/a", "https://s.example.com/a"]


def test_stored_pages_have_articles(spark, sf_dir):
    pages = discover.pages_with_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    # Only pages whose article is a few words have no text to give.
    assert pages.where("page_content IS NULL AND length(regexp_replace(html, '<[^>]*>', '')) > 1500").count() == 0
    assert pages.where("page_content IS NOT NULL").count() > 0.8 * pages.count()


def test_robots(spark):
    body = "Sitemap: https://a/s.xml\r\nSITEMAP: rel.xml\nsitemap:\n# sitemap: no"
    rows = spark.createDataFrame([("https://h.example.com", body)], "site string, body string")
    assert [r.url for r in discover.robots_sitemaps(rows).orderBy("pos").collect()] == ["https://a/s.xml", "https://h.example.com/rel.xml", "https://h.example.com"]


def test_markup_that_breaks_parsers(spark):
    paragraphs = "".join(f"<p>{LONG}{k}</p>" for k in range(5))
    deep = "<div>" * 3000 + paragraphs + "</div>" * 3000
    odd = f"<article>{paragraphs}</article><![foo bar]><p>after"
    rows = spark.createDataFrame([(1, deep), (2, odd), (3, "<"), (4, "<!--"), (5, "\x00<p \x00>"), (6, None)], "id long, html string")
    got = {r.id: r.page_content for r in discover.pages_with_text(rows).collect()}
    assert got[1].count(LONG) == 5 and got[2].count(LONG) == 5 and got[3] is got[4] is got[5] is got[6] is None


def test_addresses_that_are_none(spark):
    page = '<link type="application/rss+xml" href="http://[x"><link type="application/rss+xml" href="/ok"><link rel="alternate" type="application/atom+xml" href="//[">'
    homes = spark.createDataFrame([("https://h.example.com", page), ("http://[bad", page), (None, None)], "site string, body string")
    assert sorted((r.site, r.url) for r in discover.html_links(homes).collect()) == [("https://h.example.com", "https://h.example.com/ok")]
    robots = spark.createDataFrame([("https://h.example.com", "Sitemap: //[x\nSitemap: /s.xml")], "site string, body string")
    assert [r.url for r in discover.robots_sitemaps(robots).orderBy("pos").collect()] == [None, "https://h.example.com/s.xml"]


def test_kind_of_a_feed_behind_a_long_comment():
    comment = "<!--" + "x" * 420 + "-->"
    assert feeds.parse_feed(f'{comment}<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title></feed>')["kind"] == "ATOM"
    assert feeds.parse_feed('<rss version="2.0" xmlns:a="http://www.w3.org/2005/Atom"><channel><title>the &lt;feed</title></channel></rss>')["kind"] == "RSS"


def test_a_long_chain_of_sitemaps_with_a_cycle(spark):
    import time

    made = lambda k: f"<x><sitemapindex><sitemap><loc>s{(k + 1) % 31}</loc></sitemap></sitemapindex><urlset><url><loc>p{k}</loc></url></urlset></x>"
    raw = spark.createDataFrame([(f"s{k}", made(k)) for k in range(31)], "url string, body string")
    began = time.time()
    got = discover.sitemap_pages(spark.createDataFrame([("s0",), ("s7",)], "url string"), raw).collect()
    assert sorted((r.root, r.url) for r in got) == sorted((s, f"p{k}") for s in ("s0", "s7") for k in range(31))
    assert time.time() - began < 90


def test_expanded_sitemaps_of_a_site(spark):
    sites = spark.createDataFrame([("https://h.example.com",)], "url string")
    robots = spark.createDataFrame([("https://h.example.com", "nothing")], "site string, body string")
    raw = spark.createDataFrame([("https://h.example.com/sitemap.xml", 200, "<urlset/>"), ("https://h.example.com/sitemap", 404, "<urlset/>")], "url string, status int, body string")
    assert [tuple(r) for r in discover.site_sitemap_feeds(sites, robots, raw).collect()] == [("https://h.example.com", "https://h.example.com/sitemap.xml", "Sitemap")]


def test_the_probe_decides_on_common_paths(spark):
    body = '<rss version="2.0"><channel><title>Main</title></channel></rss>'
    sites = spark.createDataFrame([("https://a.example.org",)], "url string")
    raw = spark.createDataFrame([("https://a.example.org/feed", 500, body, 200), ("https://a.example.org/rss.xml", 200, body, 404), ("https://a.example.org/atom", 200, body, None)], "url string, status int, body string, head_status int")
    paths = lambda rows: sorted(r.url.rsplit("/", 1)[1] for r in discover.common_path_feeds(sites, rows).collect())
    assert paths(raw) == ["feed"]
    assert paths(raw.drop("head_status")) == ["atom", "rss.xml"]


@pytest.mark.parametrize("make", [lambda n: "<ul><li>" * n + "</x>" * n, lambda n: "<article>" * n, lambda n: "<li><div>" + "<b>" * n + "<li></li>" * n, lambda n: "<a " * n, lambda n: "<!--" * n, lambda n: "<p>" * n + "</b>" * n, lambda n: "<main><article class='x'>" * n])
def test_hostile_pages_take_time_in_proportion(make):
    import time

    def took(n):
        page = make(n)
        start = time.perf_counter()
        html.article_text(page)
        html.feed_links("http://a.example/", page)
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 8 * 3 * max(took(2000), 0.01)  # eight times the page; the square would be 64 times


def test_links_of_a_large_home_page_take_time_in_proportion():
    import time

    def took(n):
        page = "".join(f'<link rel="alternate" type="application/{k % 2 and "atom" or "rss"}+xml" title="T{k}" href="/f/{k}">' for k in range(n))
        start = time.perf_counter()
        got = html.feed_links("https://s.example.com", page)
        assert [x["title"] for x in got] == [f"T{k}" for k in [*range(0, n, 2), *range(1, n, 2)]]
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 8 * 3 * max(took(2000), 0.01)


@pytest.mark.parametrize("page", ["<body><p>x<link type='text/xml' href=/a><b></p><LINK rel=alternate TYPE='application/rss+xml' href='b?x=1&amp;y'/>", "<!-- <link type='text/xml' href='/no'> --><script><link type='text/xml' href='/no'></script><link type='text/xml' href='/a'>", "<link type='text/xml' href='/a'><![odd [x]]><link type='text/xml' href='/b'>", "<link type='text/xml' href>" + "<a " * 60, "<link type='text/xml' href='http://[x'><link type='text/xml' href='/c' title>"])
def test_links_are_those_of_the_tree(page):
    tree = [n.attrs for n in html.parse(page).walk() if n.tag == "link" and n.attrs.get("href")]
    want = [(u, a.get("title", ""), a["type"]) for kind in html.FEED_TYPES for a in tree if a.get("type") == kind and (u := html.joined("https://s.example.com/", a["href"]))]
    assert [tuple(x.values()) for x in html.feed_links("https://s.example.com/", page)] == want


def test_ends_of_elements():
    tree = lambda x: x if isinstance(x, str) else (x.tag, [tree(c) for c in x.children])
    cases = {
        "<ul><li>a<b>c<li>d</ul>e": [("ul", [("li", ["a", ("b", ["c"])]), ("li", ["d"])]), "e"],
        "<p>a<div>b</div>c": [("p", ["a"]), ("div", ["b"]), "c"],
        "<li><div><li>x": [("li", [("div", [("li", ["x"])])])],
        "<table><tr><td>1<td>2<tr><th>3</table>": [("table", [("tr", [("td", ["1"]), ("td", ["2"])]), ("tr", [("th", ["3"])])])],
        "</b><i>a</p>b</i>": [("i", ["a", "b"])],
        "<p>a<br>b<p>c": [("p", ["a", ("br", []), "b"]), ("p", ["c"])],
    }
    for page, want in cases.items():
        assert [tree(c) for c in html.parse(page).children] == want, page
