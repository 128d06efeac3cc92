import json

from pyspark.sql import functions as F

from quillmill import cli
from quillmill.operators import filters, ingest
from quillmill.plans import catalog
from quillmill.sources import schema, tables


def test_put_rows(spark):
    table = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, name string, active boolean")
    rows = spark.createDataFrame([(2, None), (3, "c")], "id long, name string")
    got = {r.id: (r.name, r.active) for r in ingest.put_rows(table, rows).collect()}
    assert got == {1: ("a", True), 2: (None, True), 3: ("c", None)}


def test_exactly_one(spark):
    df = spark.range(3)
    assert filters.exactly_one(df.where("id = 1"))[0].id == 1
    assert filters.exactly_one(df)[0] is None and filters.exactly_one(df.where("id > 5"))[0] is None
    assert filters.exists(df) and not filters.exists(df.limit(0))


def test_report(spark, sf_dir):
    row = catalog.queries()["stats_report"](spark, sf_dir).first()
    assert len(json.loads(row.new_articles_by_day)) == 7 and len(json.loads(row.feeds_by_type)) == 3 and len(json.loads(row.top_feeds)) == 5


def test_json_feeds(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text('[{"url": "u", "name": "n"},\n {"url": "v", "type": "atom"}]')
    assert {(r.url, r.name, r.type) for r in tables.json_feeds(spark, str(path)).collect()} == {("u", "n", None), ("v", None, "atom")}
    assert len(spark.range(1).select(tables.parse_json_feeds(F.lit(path.read_text())).alias("f")).first().f) == 2


def test_cli(spark, sf_dir, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "top_feeds" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", sf_dir]) == 2
    assert cli.main(["run", "feeds_by_type", "--data", sf_dir, "--out", str(tmp_path / "o"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 3


def test_commands_with_parameters(sf_dir, spark, capsys):
    for args in (["new-content", "--hours", "48", "--website", "n_1"], ["missing-content", "--limit", "3", "--website", "n"], ["due-feeds", "--website", "N_1"]):
        assert cli.main([*args, "--data", sf_dir]) == 0
    shown = capsys.readouterr().out
    assert "retrieved_at" in shown and "feed_url" in shown
    args = cli.parser().parse_args(["missing-content", "--limit", "3", "--data", sf_dir])
    assert cli.chosen(spark, args).count() == 3


def test_schemas_state_what_may_be_null():
    assert [f.name for f in schema.ARTICLE if f.nullable] == ["published_date"]
    assert [f.name for f in schema.FEED if f.nullable] == ["last_checked", "last_success"]


def test_plans_prune_and_push_down(spark, sf_dir):
    plan = catalog.queries()["date_range"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "o_totalprice" not in plan.split("== Physical Plan ==")[1] and "PushedFilters: [" in plan
    assert "WindowGroupLimit" in catalog.queries()["new_content_top5"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in catalog.queries()["recent_articles"](spark, sf_dir)._jdf.queryExecution().toString()
