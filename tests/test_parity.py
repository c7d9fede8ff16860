"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import math
import os

import duckdb
import pytest

from tempora import plans

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v) + 0.0:.4f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(text(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DIR)
    data = [tuple(r) for r in got.collect()]
    if name not in plans.ORACLE_SQL:
        assert data
        return
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, data) == rows(columns, want.fetchall())


def test_oracles_are_sql(duck):
    assert all(isinstance(sql, str) and duck.execute("EXPLAIN " + sql) for sql in plans.ORACLE_SQL.values()) and set(plans.ORACLE_SQL) <= set(plans.QUERIES)
