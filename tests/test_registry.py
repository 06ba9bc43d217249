"""Every registered query against its SQL, on the smallest tables; the training-data queries have tests of their own."""

import os

import duckdb
import pandas as pd
import pytest

from skeinflow import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def text(v):
    if v is None or v is pd.NA or v != v:
        return "~"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (sorted(tuple(map(text, r)) for r in df[cols].itertuples(index=False)) for df in (got, want))
    assert a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        same(got, duck.sql(registry.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_flagship(spark):
    rows = {r.diagram: (r.low, r.coeffs) for r in registry.flagship(spark, SF).collect()}
    assert rows["3_1"] == (1, [1, 0, 1, -1])
