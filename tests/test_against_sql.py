"""Every query that SQL can express, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from panelyard.checks import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat()[:19].replace("T00:00:00", "") if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", [n for n, (_, text) in catalogue().items() if text])
def test_query_agrees_with_sql(spark, sql, name):
    query, text = catalogue()[name]
    frame = query(spark, SF)
    found = sql.execute(text)
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted([tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()], key=repr)
    got = sorted([tuple(plain(r[c]) for c in order) for r in frame.collect()], key=repr)
    assert got == want
