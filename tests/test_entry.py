"""The entry points work with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_the_optional_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quillmill", tmp_path / "quillmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not e.HAS_LLM and 'top_feeds' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_folder():
    for path in (ROOT / "quillmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quillmill.llm" not in path.read_text(), path
