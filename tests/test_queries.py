"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_module
from auditlake.plans import load_queries
from auditlake.plans.views import TABLES
from check import _rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {key: q.run for key, q in load_queries().items()}
ORACLE = {key: q.sql for key, q in load_queries().items() if q.sql}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if key not in ORACLE:
        assert got[0]
        return
    cursor = duck.execute(ORACLE[key])
    assert got == _rows([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["rule_id", "name", "severity", "hits", "files"]
    assert df.count() == 24


def test_entry_module_has_them_all():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())
