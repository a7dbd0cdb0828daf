"""Work that must grow no faster than the input."""

import re
import unicodedata

from pyspark.sql import functions as F

from sluice.functions.text import plain_text
from sluice.operators import lineage, pii, standardize, synthetic
from sluice.plans import workspace


def test_edges_are_joined_with_the_nodes_twice_and_not_once_per_kind(spark, small):
    plan = lineage.edges(workspace.entities(spark, small)).select("source", "target")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("known" in line for line in plan.splitlines() if "Join " in line) == 2


def test_reach_finds_all_neighbours_of_a_hub_and_keeps_the_steps_in_place(spark):
    edges = spark.range(300).selectExpr("'hub' AS source", "concat('n', id) AS target").unionByName(
        spark.createDataFrame([("n7", "far"), ("far", None), (None, "hub"), ("far", "n7"), ("n7", "n7")], "source string, target string")
    )
    start = spark.createDataFrame([("n3",)], "id string")
    found = lineage.reach(edges, start, directed=False).where("id IS NOT NULL")
    assert found.count() == found.distinct().count() == 302
    nodes = found.unionByName(spark.createDataFrame([("alone",)], "id string")).select("id", F.lit("x").alias("type"))
    near, inside = lineage.related(nodes, edges, start)
    assert near.count() == 302 and inside.count() == 303  # edges without an end are left out


def test_only_texts_that_a_form_may_change_are_python_objects_and_few_at_a_time(spark):
    for form, first in standardize.FIRST_CHANGED.items():
        assert all(unicodedata.normalize(form, chr(c)) == chr(c) for c in range(first))
        assert any(unicodedata.normalize(form, "e" + chr(c)) != "e" + chr(c) for c in range(first, first + 16))
    texts = ["éa", "plain", None, "é", "", "ﬁn", "가", "à" * 300] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    for form in standardize.FIRST_CHANGED:
        got = dict(df.select("i", standardize.unicode_form(F.col("t"), form).alias("n")).collect())
        assert got == {i: t if t is None else unicodedata.normalize(form, t) for i, t in enumerate(texts)}
    assert "normal(CASE WHEN" in df.select(standardize.unicode_form(F.col("t"), "NFC")).columns[0]


def test_numbers_are_matched_by_length_like_their_texts(spark):
    whole = [0, -7, 12345, -12345, 99999, 123456, 1234567890, -1234567890, 11234567890, 21234567890, 4111111111111, 411111111111111, 4111111111111111,
             5105105105105100, 341111111111111, 371111111111111, 1234567890123456, 9223372036854775807, -9223372036854775808, None]
    wide = [0.5, 12345.67, -12345.0, 123.4567890, 1234567890.5, 1.5e16, 1e-7, 4111111111111111.0, 0.1234512345123456, float("nan"), float("inf"), None]
    rows = [(whole[i % len(whole)], wide[i % len(wide)]) for i in range(60)]
    df = spark.createDataFrame(rows, "n bigint, x double")
    as_text = df.select(*[plain_text(df, c).alias(c) for c in df.columns])
    assert pii.value_matches(df).collect() == pii.value_matches(as_text).collect()
    regex = [[sum(1 for r in as_text.collect() if r[c] is not None and re.search(p[0], r[c])) for p in pii.VALUE_RULES] for c in df.columns]
    assert [list(r)[3:] for r in pii.value_matches(df).collect()] == regex
    plan = pii.value_matches(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(t0") <= 7  # five of the twelve patterns cannot match a whole number


def test_sampled_rows_come_from_methods_short_enough_to_be_compiled(spark):
    df = spark.range(400).selectExpr("id", *[f"CAST(id * {7 + i} % 101 AS DOUBLE) AS x{i}" for i in range(4)], "concat('c', id % 3) AS c", "concat('d', id % 2) AS d")
    made = synthetic.sample(synthetic.fit(df, df.columns[1:]), 200)
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(made._jdf.queryExecution().executedPlan())
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    values = made.groupBy("c").count().collect()
    assert {r["c"] for r in values} == {"c0", "c1", "c2"} and sum(r["count"] for r in values) == 200
