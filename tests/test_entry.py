import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from leadloom.plans import analytics, preparation

DATA = os.environ.get("LEADLOOM_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
CORE = preparation.QUERIES | analytics.QUERIES


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())


def comparable(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v is pd.NA or v != v else f"{v:.6f}".removesuffix(".000000") if isinstance(v, float) else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(preparation.ORACLE | analytics.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert comparable(CORE[name](spark, DATA).toPandas()) == comparable(want)


@needs_data
@pytest.mark.parametrize("name", sorted(CORE.keys() - (preparation.ORACLE | analytics.ORACLE).keys()))
def test_query_runs(spark, name):
    assert CORE[name](spark, DATA).count() > 0
