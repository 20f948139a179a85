"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from sparkreel import queries as reel

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame, cols):
    def cell(v):
        return None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(
        (tuple(map(cell, r)) for r in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(reel.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = reel.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(reel.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)


def test_contract(spark):
    assert set(reel.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["l_orderkey", "pixels", "r", "g", "b"]
