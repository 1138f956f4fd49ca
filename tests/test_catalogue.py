"""Every reference query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from hazeline.plans import catalogue
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert spark_rows(catalogue.queries()[name](spark, SF)) == duck_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """In a copy without the optional subpackage and the pipeline, the entry point lists the reference queries and their SQL."""
    root = Path(__file__).parents[1]
    shutil.copytree(root / "hazeline", tmp_path / "hazeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, hazeline; print(hazeline.__file__, sorted(e.queries()) == sorted(e.catalogue.queries()), sorted(e.oracle_sql()) == sorted(e.catalogue.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(tmp_path / "hazeline/__init__.py"), "True", "True"]


def test_arg_extremes_of_equal_prices_and_nulls(spark, tmp_path):
    """Of equal prices the first order of a table in the order of its keys, as the SQL gives it on one thread; nulls are left out."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = {"o_orderkey": [1, 2, 3, 4, 5, 6, 7], "o_custkey": [1, 1, 1, 1, 1, 2, 3], "o_totalprice": [9.0, 2.0, 9.0, 2.0, None, None, 4.0]}
    pq.write_table(pa.table(rows), tmp_path / "orders.parquet")
    con = connect(tmp_path)
    con.execute("SET threads = 1")
    got = spark_rows(catalogue.queries()["arg_extremes"](spark, str(tmp_path)))
    assert got == duck_rows(con, SQL["arg_extremes"]) == (["best", "least", "o_custkey"], [("1", "2", "1"), ("7", "7", "3"), ("NULL", "NULL", "2")])
