"""Every registered query gives the rows of its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from loomwork import registry

DIR = "/root/testdata/sf0.001"


def rows(df, columns):
    plain = lambda v: None if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, (bool, int, float)) and float(v).is_integer() else str(v)
    return sorted([tuple(str(plain(v)) for v in r) for r in df[columns].itertuples(index=False)])


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        want = sql.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
