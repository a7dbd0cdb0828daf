"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import check
import __spark_entry__ as registry
from sluice.operators import lineage

FAST = (
    "io_json_array", "io_versioned_write", "q_overall", "q_issue_rank", "step_encode", "chain_trace", "fix_oversample",
    "pii_rollup", "anon_job", "gov_risk", "lineage_impact", "audit_append", "catalog_featured", "syn_overrides",
    "al_vote_entropy", "bm_holdout", "bm_leaderboard", "bm_labels",
)


def test_every_sql_belongs_to_a_query():
    assert not registry.oracle_sql().keys() - registry.queries().keys()


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, small, db, name):
    df = registry.queries()[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    relation = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in relation.description]
    assert sorted(df.columns) == sorted(names)
    assert check.canonical(df.columns, got) == check.canonical(names, relation.fetchall())


def test_reach_follows_cycles_and_directions(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    start = spark.createDataFrame([("b",)], "id string")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(lineage.reach(edges, start, directed=True)) == {"a", "b", "c"}
    assert ids(lineage.reach(edges, start, directed=False)) == {"a", "b", "c", "d"}
