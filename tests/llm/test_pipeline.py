import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldmark.llm import queries
from foldmark.llm.common import documents

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_stages_follow_each_other(spark, tmp_path):
    docs, columns = documents(spark, DATA), documents(spark, DATA).columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        now = {r[0] for r in new.select("doc_id").distinct().collect()}
        assert now <= ids
        if k < 4:
            assert new.columns == columns
        if k == 1:
            assert new.count() == new.select(F.lower("text")).distinct().count()
        docs, ids = new, now
    assert docs.count() > 0 and docs.agg(F.max("length")).first()[0] <= 1024


def test_stages_on_an_empty_table_and_extra_columns(spark):
    for rows in ([], [(1, "a b c", "en", "s", 3, 9), (2, None, None, None, None, 9), (None, "", "en", "s", 0, 9)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score int")
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * len(rows)
        assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() >= len(rows)


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert os.path.exists(DATA)
