"""Each query against its SQL on the smallest tables."""

import os
from datetime import date
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from ledgerloom.plans import catalog as queries

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        one = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, Number) else str(pd.Timestamp(v)) if isinstance(v, (date, pd.Timestamp)) else str(v)
        rows = lambda df: sorted([one(v) for v in r] for r in df[columns].itertuples(index=False))
        assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
