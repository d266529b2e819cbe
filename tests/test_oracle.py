"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from evalframe import plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = {name: entry.queries()[name] for name in plans.QUERIES}, plans.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    names, rows = rows_of(frame.columns, frame.collect())
    assert name in ORACLES
    cursor = duck.execute(ORACLES[name])
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert names == want_names
    assert rows == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
