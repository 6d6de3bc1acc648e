"""The driver's contract: a sample of queries against their SQL twins on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SAMPLE = ("panel_f3", "asof_fundamentals", "ts_rank", "ts_regression_residual", "cs_rank", "map_div", "formula_levels", "ic_summary", "long_short", "drawdown_cap", "cost_grid", "candidate_counts")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def key(row):
    return tuple((x is None, f"{x:.4f}" if isinstance(x, float) else str(x)[:10]) for x in row)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sql, name):
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = entry.oracle_sql()[name]
    assert cols == sorted(sql.sql(want).columns)
    a = sorted(map(tuple, got.select(*cols).collect()), key=key)
    b = sorted(sql.execute(f"SELECT {', '.join(cols)} FROM ({want})").fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if isinstance(u, float):
                assert v is not None and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6)
            elif not hasattr(u, "year"):
                assert u == v


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "name" and out.count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 70


@pytest.mark.parametrize("left", [("quantaloom/llm", "tests/llm"), ("quantaloom/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_works_without_the_corpus_part(tmp_path, left):
    """A copy of the library without the corpus operators, the pipeline or both still imports and lists the other queries."""
    root = Path(entry.__file__).resolve().parent
    for name in ("quantaloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in left:
        gone = tmp_path / name
        if gone.is_dir():
            shutil.rmtree(gone)
        else:
            gone.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(said[-2]) >= 70 and said[-1] == "False"
