"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from bilateral.plans.catalog import oracle_sql, queries

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def key(row):
    return tuple((v is None, round(v, 3) if isinstance(v, float) else v) if not isinstance(v, str) else (False, v) for v in row)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = queries()[name](spark, SF)
    want = con.sql(oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    b = sorted((tuple(r) for r in want.select(*[f'"{c}"' for c in names]).fetchall()), key=key)
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or isinstance(u, float) and v is not None and math.isclose(u, float(v), rel_tol=1e-7, abs_tol=2e-6), (x, y)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_other_queries_run(spark, name):
    assert queries()[name](spark, SF).count() > 0
