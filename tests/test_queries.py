"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from sparkloom import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, FOLDER)
    rows = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(found.columns) == sorted(want.columns)
        at = [want.columns.index(c) for c in sorted(want.columns)]
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() > 0
