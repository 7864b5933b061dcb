"""The registry, and queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from scrublake import queries as own

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(own.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["pii_scan", "sanitize_documents", "nms", "ocr_lines", "snapshot_diff", "page_links", "letterbox"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = own.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    shown = lambda rows: sorted("|".join("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    expected = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({own.ORACLE_SQL[name]})").fetchall()
    assert shown(map(tuple, got.select(*cols).collect())) == shown(expected)
