"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
SQL = {k: v for k, v in contract.oracle_sql().items() if not (k[:2] == "op" and k[2].isdigit()) and k != "pipeline"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)):
            return str(round(float(v), 6))
        return str(v).removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = contract.queries()[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
