"""The operators' SQL against their queries over whole tables."""

import os

import duckdb
import pytest

from matchloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_operator(spark, data, name):
    sql = duckdb.connect()
    for file in os.listdir(data):
        sql.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    want = sql.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries()[name](spark, data).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
