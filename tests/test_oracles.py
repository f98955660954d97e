"""Every registered query of the library against its SQL on the given tables."""

import os

import duckdb
import pandas as pd
import pytest

from albumen.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if not isinstance(v, str) and pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(cell, r)) for r in df.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
