"""Every registered query against its SQL oracle, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from foldmark import checks

DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = checks.all_queries(), checks.all_oracles()  # those of the training-data operators are in tests/llm


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
