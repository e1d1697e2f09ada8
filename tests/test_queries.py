"""Every registered query on the smallest data; those with an SQL twin must equal it."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n_users"] for r in rows) > 0
