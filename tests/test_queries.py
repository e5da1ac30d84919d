"""Every registered core query: against its SQL twin, or that it runs."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, duck

from stackroom.plans.catalogue import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    if name in SQL:
        assert compare(spark, sf_dir, name, QUERIES[name], SQL[name], con) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_without_the_subpackage():
    """The rest works where the training-data subpackage is absent."""
    code = "import sys; sys.modules['stackroom.llm'] = None; import __spark_entry__ as e; assert 'p6_found' in e.queries() and 'p1_found' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_workers_elsewhere_get_the_package(sf_dir, tmp_path):
    """A session started in another folder, without the repository on the workers' path."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').getOrCreate(); "
        f"assert e.queries()['search_stemmed_en'](s, {sf_dir!r}).count() >= 0"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})


def test_nothing_outside_imports_it():
    for p in (ROOT / "stackroom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "stackroom.llm" not in p.read_text(), p
