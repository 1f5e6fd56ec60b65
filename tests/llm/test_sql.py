"""The queries that SQL can state, against DuckDB on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry_module
from check import _rows

SF_DIR = "/root/testdata/sf0.001"
NUMBERED = {f"op{n}_" for n in range(1, 14)}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


def test_every_operator_has_a_query():
    names = [k for k in entry_module.queries() if k.startswith("op")]
    assert {k.split("_")[0] + "_" for k in names} == NUMBERED and len(names) == 13
    assert "pipeline" in entry_module.queries()


@pytest.mark.parametrize("key", ["op1_line_frequency", "op2_warc_seekable_zstd", "op12_source_divergence"])
def test_sql(spark, key):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = entry_module.queries()[key](spark, SF_DIR)
    cursor = duck.execute(entry_module.oracle_sql()[key])
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == want
