"""Every catalogued query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from ordina.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ in ("Decimal", "int64", "float64"):
        return round(float(value), 9)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = [tuple(plain(row[i]) for i in place) for row in found.fetchall()]
    rows = [tuple(plain(row[c]) for c in columns) for row in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_each_query_has_sql():
    without = set(QUERIES) - set(SQL)
    assert not without
