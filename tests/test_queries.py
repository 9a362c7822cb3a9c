"""Every registered query against its DuckDB twin, on the smallest tables."""

import os

import pytest

from fieldlark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    near = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(near, r)) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert tidy(tuple(r[c] for c in cols) for r in df.collect()) == tidy(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
