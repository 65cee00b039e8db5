"""Queries with SQL against it."""

import duckdb
import pytest
from bilateral.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    got = queries()[name](spark, tiny)
    names = sorted(got.columns)
    want = con.sql(oracle_sql()[name])
    assert sorted(want.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(want.select(*names).fetchall(), key=str)
