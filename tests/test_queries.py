"""Every query against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from marlstone import queries

DIR = "/root/testdata/sf0.001"
ORACLE = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(df.columns)]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
