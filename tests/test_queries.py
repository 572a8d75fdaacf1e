"""Every catalog query against its SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

from talus.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(ORACLES[name])
    want = sorted(repr(tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols)) for r in rel.fetchall())
    assert sorted(rel.columns) == cols
    assert got == want
