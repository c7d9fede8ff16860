"""The SQL of the training-data queries gives their rows on the smallest tables."""

import os

import duckdb
import pytest

from tempora.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert isinstance(queries.ORACLE_SQL[name], str)
    got, want = queries.QUERIES[name](spark, DIR), duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_every_query_says_what_it_returns():
    assert all(q.__doc__ for q in queries.QUERIES.values()) and len(queries.QUERIES) == 13
