import os

import duckdb
import pytest

pytest.importorskip("ahocorasick")
from leadloom.llm import queries  # noqa: E402
from tests.test_entry import DATA, comparable, needs_data  # noqa: E402


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    assert comparable(queries.QUERIES[name](spark, DATA).toPandas()) == comparable(con.execute(queries.ORACLE[name]).fetchdf())


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE.keys()))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
