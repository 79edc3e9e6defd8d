"""Every registered query against its SQL in DuckDB, and the entry file's contract."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanrank import queries as engine
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if x is None or isinstance(x, float) and math.isnan(x) else x for x in r) for r in frame.astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    got = engine.QUERIES[name](spark, SF).toPandas()
    if name in engine.ORACLES:
        want = duck.execute(engine.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(engine.QUERIES) <= set(entry.queries())
