"""Every registered query with SQL of its own against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from textloom.plans import catalogue, readings, roundtrips

ALL = catalogue.QUERIES | roundtrips.QUERIES | readings.QUERIES
SQL = catalogue.ORACLE_SQL | roundtrips.ORACLE_SQL | readings.ORACLE_SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ALL))
def test_equals_duckdb(spark, data, duck, name):
    got = ALL[name](spark, data)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert ordered(ours) == ordered([tuple(map(plain, r)) for r in want.fetchall()])


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = catalogue.QUERIES["filter_pred"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan
    assert "o_orderdate" not in plan
