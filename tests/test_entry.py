"""The driver's entry module, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from metalith.plans import catalogue

TOP = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
LISTING = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("gone", [["metalith/llm", "tests/llm"], ["metalith/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    """The rest is importable and lists its queries, whichever of the optional parts are deleted."""
    there = shutil.copytree(TOP, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = there / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LISTING], cwd=there, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names = set(done.stdout.split())
    assert set(catalogue.QUERIES) <= names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ("metalith/llm" not in gone and (there / "metalith" / "llm").is_dir())


def test_each_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
