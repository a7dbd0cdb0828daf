"""Helpers that must hold when one key has most of the rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import lookups, ranks
from sluice.functions.draws import draw
from sluice.functions.quantiles import quantiles


def py_draw(key, seed):
    return int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def uneven(spark):
    """1,000 rows; a third has the class 'hot', the rest many small classes and some nulls."""
    cls = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('c', CAST(id % 70 AS STRING)) END"
    return spark.range(1000).selectExpr("id", f"{cls} AS cls", "CAST(id * 7 % 11 AS DOUBLE) AS x")


def test_draw_is_md5(spark):
    row = spark.range(1).select(draw(F.lit(7), 42).alias("d")).first()
    assert row["d"] == py_draw(7, 42)


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_index(uneven, parts):
    got = ranks.ordered_index(uneven.repartition(parts), [F.col("cls").desc_nulls_first(), "id"], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(1000))
    nulls = [r for r in got if r["cls"] is None]
    assert {r["at"] for r in nulls} == set(range(len(nulls)))
    rest = sorted((r for r in got if r["cls"] is not None), key=lambda r: r["at"])
    assert [r["cls"] for r in rest] == sorted((r["cls"] for r in rest), reverse=True)


def test_running_sum_and_numbers(uneven):
    rows = ranks.running_sum(uneven, ["id"], "x", "upto").orderBy("id").collect()
    assert [r["upto"] for r in rows] == list(np.cumsum([r["x"] for r in rows]))
    numbered = ranks.number_within(uneven, ["cls"], ["id"], "n").collect()
    seen = {}
    for r in sorted(numbered, key=lambda r: r["id"]):
        seen[r["cls"]] = seen.get(r["cls"], 0) + 1
        assert r["n"] == seen[r["cls"]]


@pytest.mark.parametrize("parts", [1, 8])
def test_rank_by_draw(uneven, parts):
    got = ranks.rank_by_draw(uneven.repartition(parts), ["cls"], "id", 5, "rank", "size").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cls"], []).append(r)
    for rows in groups.values():
        ordered = sorted(rows, key=lambda r: (py_draw(r["id"], 5), r["id"]))
        assert [r["rank"] for r in ordered] == list(range(1, len(rows) + 1))
        assert {r["size"] for r in rows} == {len(rows)}


@pytest.mark.parametrize("k", [0, 1, 333, 1000, 5000])
def test_lowest_draws(uneven, k):
    got = {r["id"] for r in ranks.lowest_draws(uneven, "id", 42, k).collect()}
    assert got == set(sorted(range(1000), key=lambda i: (py_draw(i, 42), i))[:k])


@pytest.mark.parametrize("limit", [0, 10, 10_000])
def test_attach_hot_and_cold_keys(uneven, monkeypatch, limit):
    """The same result whether the table is broadcast or only its hot keys are."""
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(lookups, "HOT_SHARE", 20)
    table = (
        uneven.where("cls IS NOT NULL AND cls <> 'c5'").groupBy(F.col("cls").alias("key")).agg(F.count("id").alias("n"))
        .withColumn("code", F.length("key") * 100 + F.col("n"))
    )
    known = {r["key"]: r["code"] for r in table.collect()}
    got = lookups.attach(uneven, "cls", table, "code", "code").collect()
    assert len(got) == 1000
    assert all(r["code"] == known.get(r["cls"]) for r in got)


def test_exact_quantiles(spark):
    df = spark.range(20_000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(pow(id % 997, 2) AS DOUBLE) END AS a",
        "CASE WHEN id % 3 = 0 THEN 5 ELSE CAST(id % 13 AS INT) END AS b",
        "CAST(NULL AS DOUBLE) AS c",
        "rand(3) AS d",
    ).cache()
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["column"]: r for r in quantiles(df, ["a", "b", "c", "d"], probs).collect()}
    pdf = df.toPandas()
    for c in ("a", "b", "d"):
        values = pdf[c].dropna().to_numpy(dtype=float)
        assert got[c]["n"] == len(values)
        np.testing.assert_allclose(got[c]["q"], np.percentile(values, [p * 100 for p in probs]), rtol=1e-12)
    assert "c" not in got or got["c"]["q"] is None


@pytest.mark.parametrize("n", [3, 5_000])
def test_few_rows_drawn_often(spark, n):
    """Every draw finds its row, whether rows are salted or not."""
    rows = spark.createDataFrame([(i + 1, f"r{i}") for i in range(7)], "__rank bigint, name string")
    picks = spark.range(n).selectExpr("id AS __pick", "id % 7 + 1 AS __rank")
    got = ranks.take_ranks(picks, rows, 7, n)
    assert got.count() == n and got.where("name <> concat('r', __rank - 1)").count() == 0


def test_training_rows_are_dealt_by_a_shuffle(spark):
    from sluice.operators.models import compact

    plan = compact(spark.range(100, numPartitions=16), 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 1, true" in plan
