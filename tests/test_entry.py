import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from strandline.plans import catalogue
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "documents", "embeddings", "events", "labels", "nation", "orders", "region"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@tables
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql(spark, con, name):
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    found = catalogue.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    flat = lambda rows: sorted(str([x + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    assert flat(found.select(*columns).collect()) == flat(want.fetchall())


@tables
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
