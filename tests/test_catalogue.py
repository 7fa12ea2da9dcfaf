"""Every registered query of the reference's operators against its DuckDB formulation, on the smallest tables."""

import decimal
import glob
import math
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {path.split('/')[-1].split('.')[0]} as select * from read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    result = duck.execute(catalogue.ORACLES[name])
    order = [[d[0] for d in result.description].index(n) for n in names]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_instruction_rules_of_words_that_orders_are_made_of(spark, tmp_path):
    words = ("use", "call", "import", "access", "invoke", "never", "must", "should", "always", "instead", "interna", "openai", "test", "from", "domain", "inea")
    own = [(30 * k + i, f"{w} x", "en", "src0") for k, w in enumerate(words) for i in range(30)]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in catalogue.QUERIES["instruction_rules"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(catalogue.ORACLES["instruction_rules"]).fetchall())


def test_entry_module_lists_everything():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())


def test_entry_module_without_the_training_data_folders(tmp_path):
    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for leftover in (False, True):
        if leftover:
            (tmp_path / "tessera" / "llm").mkdir()  # an empty folder
        told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        assert told.stdout.split() == [str(len(catalogue.QUERIES)), "False"]
