"""The registered queries on the smallest tables, against their SQL or brute force."""

import duckdb
import pytest

import check
import corpus_pipeline
from sluice.llm.queries import QUERIES
from sluice.llm.sql import SQL


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, db, name):
    df = QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    relation = db.execute(SQL[name])
    names = [c[0] for c in relation.description]
    assert sorted(df.columns) == sorted(names)
    assert check.canonical(df.columns, got) == check.canonical(names, relation.fetchall())


def test_pipeline_stages_keep_the_columns_and_their_promises(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{number}")
        back = spark.read.parquet(f"{tmp_path}/{number}")
        left = {r[0] for r in back.select("doc_id").distinct().collect()}
        assert left <= ids, name
        if name == "secret scan":
            assert left == ids
            assert QUERIES["op6_secret_scan"] and back.where("text LIKE '%AKIA%' AND text RLIKE 'AKIA[A-Z0-9]{16,}'").count() == 0
        if number < len(corpus_pipeline.STAGES) - 1:
            assert back.columns == columns
            docs, ids = back, left
    assert left == ids  # every document that was kept is packed
    assert corpus_pipeline.run(spark, small).count() == back.count()


def test_stages_take_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_redaction_keeps_missing_texts_and_other_columns(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, 'a password="abcdefgh" b', "en", None, 9), (2, None, "en", "s", None), (None, "", None, "s", 0), (3, "plain", "de", "s", 77)]
    docs = spark.createDataFrame(rows, schema)
    got = corpus_pipeline.redact(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 'a [secret]" b', "en", None, 13), *rows[1:]], key=str)
