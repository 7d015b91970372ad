"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
from datagauge.plans import ORACLE, QUERIES  # noqa: E402


def cell(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") and x.tzinfo else x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(map(cell, r)) for r in df.select(columns).collect())))
    if name in ORACLE:
        rel = db.sql(ORACLE[name])
        assert sorted(rel.columns) == columns
        order = [rel.columns.index(c) for c in columns]
        want = sorted(repr(tuple(cell(r[i]) for i in order)) for r in rel.fetchall())
        assert got == want
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 200
