"""Every query of the library against its SQL, and that the entry points work without the training-data operators."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from lakeloom import catalog
from lakeloom.catalog import base
from tools.compare import rows

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equal_to_sql(spark, data, con, name):
    df = catalog.QUERIES[name](spark, data)
    cur = con.execute(catalog.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(base.CASES))
def test_fixture_equal_to_sql(spark, con, name):
    run, sql = base.CASES[name]
    df, cur = run(spark), con.execute(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).limit(5).collect() is not None


def test_entry_without_training_data_operators(tmp_path):
    for name in os.listdir(REPO):
        if name.startswith(".") or name in ("corpus_pipeline.py", "tests", "lakeloom"):
            continue
        os.symlink(f"{REPO}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "lakeloom")
    for name in os.listdir(f"{REPO}/lakeloom"):
        if name != "llm":
            os.symlink(f"{REPO}/lakeloom/{name}", tmp_path / "lakeloom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_library_does_not_import_them():
    for path in glob.glob(f"{REPO}/lakeloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "lakeloom.llm" not in open(path).read(), path
