"""Every query of the core against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from callgrain.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return ""
        return repr(round(float(v), 5) + 0.0) if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["template_duplicates", "tokenizer_fertility"])
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0
