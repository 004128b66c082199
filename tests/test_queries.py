"""Every query with SQL gives the same rows as that SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lintel.plans import io_queries, lake_queries, model_queries  # noqa: F401
from lintel.plans.registry import ORACLES, QUERIES
from lintel.plans.views import TABLES


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    if not os.path.isdir(sf):
        pytest.skip("tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
