"""Queries with SQL equal it on the smallest tables, on all rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from aircadence.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(_plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())
