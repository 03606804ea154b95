"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from plyforge.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(frame):
    return sorted(tuple(str(v) for v in row) for row in frame[sorted(frame.columns)].astype(str).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_optional_parts(tmp_path, with_pipeline):
    """A copy of the repository without the llm folders, with or without corpus_pipeline.py, imports and lists the catalogue."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/plyforge", tmp_path / "plyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "plyforge/llm/__pycache__").mkdir(parents=True)
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    if with_pipeline:
        shutil.copy(f"{here}/corpus_pipeline.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], said.stderr


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["pair_matrix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "l_extendedprice" not in plan and "c_name" not in plan


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_join(spark, name):
    """Only the range join of indices with bucket starts, a row a bucket, has no equality to join on."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name == "prefix_locate" or "BroadcastNestedLoopJoin" not in plan
