import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import text as x


@pytest.mark.parametrize(
    ("url", "title"),
    [("https://x.com/a/foo-bar/", "Foo Bar"), ("https://x.com/it's-2nd.html?x=1", "It'S 2Nd.Html?X=1"), ("https://x.com/", "X.Com"), ("plain", "Plain"), ("//", "//")],
)
def test_slug_title(spark, url, title):
    assert spark.range(1).select(x.slug_title(F.lit(url))).first()[0] == title


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=30), min_size=1, max_size=40))
def test_title_case_and_hash_agree_with_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", x.title_case(F.col("t")), x.content_hash(F.col("t"), F.lit("c"), F.col("t"))).collect()
    for t, title, digest in rows:
        assert title == t.title()
        assert digest == hashlib.sha256((t + "c" + t).encode()).hexdigest()


def test_hash_is_kept_back_without_content(spark):
    assert spark.range(1).select(x.stored_hash(F.lit("t"), F.lit(""), F.lit("s"))).first()[0] == ""


def test_clip_widths(spark):
    row = spark.range(1).select(x.clip(F.lit("a" * 501), 500), x.clip(F.lit("a" * 500), 500), x.clip(F.lit("a" * 61), 60)).first()
    assert (row[0], row[1], row[2]) == ("a" * 497 + "...", "a" * 500, "a" * 57 + "...")


def test_repaired_title(spark):
    url = F.lit("https://x.com/a/some-story///")
    row = spark.range(1).select(x.repaired_title(url, url), x.repaired_title(F.lit("a/b"), url), x.repaired_title(F.lit("Kept"), url)).first()
    assert tuple(row) == ("Some Story", "Some Story", "Kept")


def test_search_is_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), (None,)], "t string")
    assert [r.t for r in df.where(x.contains_ci(F.col("t"), "0% O")).collect()] == ["50% off"]


def test_search_without_accents(spark):
    df = spark.createDataFrame([("Crème Brûlée",), ("creme",), ("cream",)], "t string")
    assert df.where(x.contains_plain(F.col("t"), "CREME")).count() == 2
