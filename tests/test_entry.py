"""The registered queries against their SQL on the smallest tables, and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", ENGINE)
def test_query_matches_sql(spark, db, name):
    rows = entry.queries()[name](spark, SF)
    cols = sorted(rows.columns)
    got = [tuple(r) for r in rows.select(*cols).collect()]
    spark.catalog.clearCache()
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    near = lambda x: round(x, 4) + 0.0 if isinstance(x, float) else x
    key = lambda r: str(tuple(map(near, r)))
    assert sorted(map(key, got)) == sorted(map(key, want))


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_subpackage(tmp_path):
    """Everything else imports and works when the subpackage, its tests and the pipeline are gone."""
    shutil.copytree(ROOT / "confuscope", tmp_path / "confuscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for p in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / p, tmp_path / p)
    code = "import bench, __spark_entry__ as e; assert 'flagship' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'], sorted(e.queries())"
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}:{os.environ.get('PYTHONPATH', '')}", "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    # All tests collect, and those of counting pass.
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path, env=env, check=True, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/engine/test_counts.py"], cwd=tmp_path, env=env, check=True, stdout=subprocess.DEVNULL)


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "confuscope", tmp_path / "confuscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "confuscope" / "llm").mkdir()
    (tmp_path / "confuscope" / "llm" / "__init__.py").write_text("")
    (tmp_path / "confuscope" / "llm" / "queries.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr
