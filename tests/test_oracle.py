"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

from .conftest import SF

NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, tuples):
    at = [names.index(n) for n in sorted(names)]
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(t[i]) for i in at) for t in tuples)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
