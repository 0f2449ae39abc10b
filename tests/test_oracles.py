"""Every query that has a DuckDB twin gives the twin's rows, on the tables that the driver compares them on: exact columns exactly, floats to nine places."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from skerry import plans

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    """Numbers as numbers, so that an integer equals the float of its value; all else as text."""
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, (float, np.floating)) and math.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        return float(x) + 0.0  # one zero
    if isinstance(x, (dt.date, dt.datetime, pd.Timestamp)):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    """In order of what is not a fraction, then of the fractions."""
    df = df[sorted(df.columns)].astype(object)
    whole = lambda x: x if not isinstance(x, float) else x + 0.0 if x == x and x == int(x) else 0.5
    order = lambda r: ([str(whole(x)) for x in r], [round(x, 4) for x in r if isinstance(x, float)])
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=order)


def same(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_its_twin(spark, duck, name):
    mine, other = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    a, b = rows(mine), rows(other)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))] == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_others_give_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).limit(1).count() == 1
