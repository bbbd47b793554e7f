import os
import subprocess
import sys
import time

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, canonical
from tidewake.plans.oracles import ORACLES
from tidewake.plans.queries import QUERIES

NAMES = sorted(QUERIES)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(NAMES) == set(ORACLES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0].total == 14


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    got = queries()[name](spark, sf).toPandas()
    if name not in oracle_sql():
        assert len(got) > 0
        return
    want = con.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_scratch_is_one_folder_that_goes_with_the_application(spark, tmp_path):
    """A driver of its own writes, reads and ends; its folder is gone and the others are not."""
    code = ("import sys; sys.path.insert(0, sys.argv[2])\n"
            "from tidewake import session\n"
            "s = session.get_session('a', 'local[1]', **{'spark.checkpoint.dir': sys.argv[1], 'spark.ui.enabled': 'false'})\n"
            "print('ROWS', session.stored(s.range(7)).count() + session.stored(s.range(5)).count())\n"
            "import os; print('FOLDERS', len([x for x in os.listdir(sys.argv[1]) if x.startswith('tidewake-')]))\n")
    (tmp_path / "other").mkdir()
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code, str(tmp_path), here], capture_output=True, text=True, timeout=180).stdout
    assert "ROWS 12" in said and "FOLDERS 1" in said
    for _ in range(100):
        if not any(x.startswith("tidewake-") for x in os.listdir(tmp_path)):
            break
        time.sleep(0.2)
    assert "other" in os.listdir(tmp_path) and not any(x.startswith("tidewake-") for x in os.listdir(tmp_path))
