from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers start in other folders and need the package too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame):
    """Rows with columns by name and values as text, in order: what two engines must agree on."""
    import pandas as pd

    def text(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([text(x) for x in v])
        return str(int(v)) if type(v).__name__.startswith(("int", "uint")) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    def check(make, sql):
        left, right = rows_of(make(spark, sf_dir).toPandas()), rows_of(duck.execute(sql).df())
        assert left[0] == right[0]
        assert len(left[1]) == len(right[1])
        assert left[1] == right[1]

    return check
