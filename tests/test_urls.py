"""Addresses joined by SQL functions against the standard library."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from quillmill.functions.urls import resolve

BASES = ["https://h.example", "https://h.example/", "http://h.example/a/b/c?q=1#f", "https://h.example:8080/a/b/", "HTTPS://User@H.example/x;p", "https://h.example/a/b;c=1;d", "https://h/a//b/../c", "https://[::1]/a", "https://h.example//", "ftp://f/a/b", "mailto:a@b", "a/b", ""]
REFS = [
    "", "g", "./g", "g/", "/g", "//o.example", "//o.example/p;?q#", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g",
    "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/../x", "http:g", "https:g", "https:///x", "mailto:x@y", "javascript:alert(1)", "data:,x", "1a:b", "a b", " \t/x\n", "x\ny",
    "https://o.example/a/../b", "HTTP://O.example", "//[::1]/x", "//[::1/x", "//a]b", "//[zz]/x", "//a℀b/x", "/ü/日", "a//b", "//", "///x", "/a//b/./c//../d", ";", "a;", "..;x", "?", "#", "a/..;", "\x01/x",
]


def expected(base, ref):
    if base is None or ref is None:
        return None
    try:
        return urljoin(base.rstrip("/"), ref)
    except ValueError:
        return None


def check(spark, pairs):
    pairs = list(dict.fromkeys(pairs))
    rows = spark.createDataFrame([(k, b, r) for k, (b, r) in enumerate(pairs)], "k long, b string, r string").select("k", resolve("b", "r").alias("x")).collect()
    wrong = [(pairs[row.k], row.x, expected(*pairs[row.k])) for row in rows if row.x != expected(*pairs[row.k])]
    assert not wrong and len(rows) == len(pairs)


def test_listed_references(spark):
    check(spark, [(b, r) for b in [*BASES, None] for r in [*REFS, None]])


def test_random_references(spark):
    r = random.Random(7)
    pieces = ["a", "b", ".", "..", "/", "/", "/", "?", "#", ";", "x=1", "//", "http:", "h.example", ":", "%2e", "é"]
    make = lambda n: "".join(r.choice(pieces) for _ in range(r.randrange(n)))
    check(spark, [("https://h.example/" + make(6), make(9)) for _ in range(4000)])


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(resolve(F.lit("https://h/").substr(1, 10), F.col("id").cast("string")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
