"""Commands that write, from parameters to tables, and lists of feeds against plain code."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

from quillmill import cli
from quillmill.operators.library import Library

AS_OF = datetime(2024, 5, 1, 12)
KIND = "pos long, site_url string, site_name string, url string, name string, type string"


def stored(library):
    sites = {r.id: r.url for r in library.sites.read().collect()}
    feeds = library.feeds.read().collect()
    assert len({r.id for r in feeds}) == len(feeds) == len({r.feed_url for r in feeds})
    return {r.feed_url: (sites[r.website_id], r.feed_type, r.title, r.description) for r in feeds}


def one_by_one(feeds, rows):
    """Entries put in one after the other."""
    counts = {"created": 0, "updated": 0, "skipped": 0}
    for _, site, site_name, url, name, kind in rows:
        if not url:
            continue
        site = site if site.startswith(("http://", "https://")) else f"https://{site}"
        if not url.startswith(("http://", "https://")):
            url = ("https://" if site.startswith("https://") else "http://") + url
        kind = (kind or "RSS").upper()
        if url not in feeds:
            feeds[url] = (site, kind if kind in ("RSS", "ATOM", "SITEMAP") else "RSS", name or "", f"{site_name} - {name}" if name else "")
            counts["created"] += 1
        elif name and not feeds[url][2]:
            feeds[url] = (*feeds[url][:2], name, feeds[url][3])
            counts["updated"] += 1
        else:
            counts["skipped"] += 1
    return counts


def test_lists_are_put_in_one_by_one(spark, tmp_path):
    r = random.Random(2)
    library, want = Library(spark, str(tmp_path), 4), {}
    for batch in range(3):
        rows = [(k, r.choice(["s.example", "http://t.example"]), "S", r.choice(["", None, *(f"f{j}.example/x" for j in range(12)), "https://f1.example/x"]), r.choice(["", None, "N", "M"]), r.choice([None, "atom", "sitemap", "rss", "odd"])) for k in range(25)]
        assert library.add_feeds(batch, spark.createDataFrame(rows, KIND), AS_OF) == one_by_one(want, rows)
        assert stored(library) == want
        library.add_feeds(batch, spark.createDataFrame(rows, KIND), AS_OF)  # once more changes nothing
        assert stored(library) == want
    assert library.sites.read().count() == 2 and library.next_batch() == 3
    assert library.add_feeds(3, spark.createDataFrame([], KIND), AS_OF) == {"created": 0, "updated": 0, "skipped": 0} and stored(library) == want


@pytest.fixture
def documents(spark, tmp_path):
    rss = '<rss version="2.0"><channel><title>{}</title><description>told</description></channel></rss>'
    home = '<html><head><link type="application/rss+xml" title="Linked" href="/linked"><link type="application/atom+xml" href="https://s.example/a.xml"></head></html>'
    rows = [
        ("https://s.example", 200, home), ("https://s.example/linked", 200, rss.format("Own title")), ("https://s.example/a.xml", 404, rss.format("gone")), ("https://s.example/feed", 200, rss.format("Common")),
        ("https://s.example/robots.txt", 200, "Sitemap: /maps.xml"), ("https://s.example/maps.xml", 200, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s.example/1</loc></url></urlset>'),
    ]
    spark.createDataFrame(rows, "url string, status int, body string").write.parquet(str(tmp_path / "raw"))
    return str(tmp_path / "raw")


def test_discovery_from_parameters_to_tables(spark, tmp_path, documents, capsys):
    args = ["discover-feeds", "s.example", "--name", "Site", "--library", str(tmp_path / "lib"), "--documents", documents, "--as-of", "2024-05-01T12:00:00"]
    assert cli.main(args) == 0 and "4 new feeds" in capsys.readouterr().out
    library, site = Library(spark, str(tmp_path / "lib")), "https://s.example"
    want = {
        "https://s.example/linked": (site, "RSS", "Own title", "told"), "https://s.example/a.xml": (site, "ATOM", "", ""),
        "https://s.example/feed": (site, "RSS", "Common", "told"), "https://s.example/maps.xml": (site, "SITEMAP", "Sitemap (1 URLs)", ""),
    }
    assert stored(library) == want
    assert [(r.url, r.name, r.active, r.created_at) for r in library.sites.read().collect()] == [(site, "Site", True, AS_OF)]
    assert cli.main(args) == 0 and "0 new feeds" in capsys.readouterr().out
    assert stored(library) == want


def test_added_feeds_from_parameters_to_tables(spark, tmp_path, documents, capsys):
    text = json.dumps([{"url": "s.example/linked", "name": "L", "type": "atom"}, {"name": "no address"}, {"url": "https://s.example/none"}])
    (tmp_path / "list.json").write_text(json.dumps([{"url": "https://s.example/none", "name": "Later"}, {"url": "https://s.example/linked", "name": "Other"}], indent=1))
    place = ["--website-url", "s.example", "--website-name", "Site", "--library", str(tmp_path / "lib")]
    assert cli.main(["add-feeds", *place, "--feeds-json", text]) == 0 and "2 created, 0 updated, 0 skipped" in capsys.readouterr().out
    assert cli.main(["add-feeds", *place, "--feeds-file", str(tmp_path / "list.json"), "--validate", "--documents", documents]) == 0
    assert "0 created, 1 updated, 1 skipped" in capsys.readouterr().out
    library = Library(spark, str(tmp_path / "lib"))
    assert stored(library) == {"https://s.example/linked": ("https://s.example", "ATOM", "L", "Site - L"), "https://s.example/none": ("https://s.example", "RSS", "Later", "")}
    checked = library.validity(spark.createDataFrame([("https://s.example",)], "url string"), spark.read.parquet(documents))
    assert {(r.feed_url, r.title, r.valid) for r in checked.collect()} == {("https://s.example/linked", "L", True), ("https://s.example/none", "Later", False)}
    for bad in ("[]", "no json"):
        with pytest.raises(SystemExit):
            cli.main(["add-feeds", *place, "--feeds-json", bad])
    assert SparkSession.getActiveSession() is not None
