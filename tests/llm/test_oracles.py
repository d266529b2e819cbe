"""The queries that SQL can express against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from check import TABLES, rows_of
from evalframe.llm import queries  # noqa: F401
from evalframe.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    frame = QUERIES[name](spark, sf)
    names, rows = rows_of(frame.columns, frame.collect())
    cursor = con.execute(ORACLES[name])
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert (names, rows) == (want_names, want) and rows
