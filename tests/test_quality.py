import pytest
from pyspark.sql import functions as F

from sluice.operators import profile, quality


def scan_of(spark, rows, schema):
    return quality.Scan(spark.createDataFrame(rows, schema))


def found(scan):
    return {(r["column_name"], r["issue_type"], r["dimension"]): r for r in scan.issues().collect()}


def test_planted_defects(spark):
    rows = [(i, float(i % 10), "Ab" if i % 2 else "ab", "yes" if i % 40 else "no") for i in range(100)]
    rows[3] = (3, None, "ab", None)
    rows[5] = (5, 1e6, "Ab", "yes")
    rows += [rows[7], rows[7]]
    issues = found(scan_of(spark, rows, "id int, x double, word string, label string"))
    assert issues[(None, "duplicate_rows", "consistency")]["affected_count"] == 2
    assert issues[("x", "null_values", "completeness")]["severity"] == "info"
    assert issues[("x", "outliers", "accuracy")]["affected_count"] == 1
    assert issues[("x", "high_skew", "distribution")]["affected_count"] == 101
    assert issues[("word", "mixed_case", "consistency")]["description"].startswith("Mixed case values in 'word'")
    assert issues[("label", "null_labels", "label_quality")]["severity"] == "warning"
    assert issues[("label", "class_imbalance", "distribution")]["impact_score"] == 8.0
    assert ("label", "class_imbalance", "label_quality") in issues


def test_issue_order(spark):
    rows = [(i, None if i % 4 == 0 else i, None if i % 15 == 0 else "v") for i in range(60)]
    placed = scan_of(spark, rows, "id int, a int, b string").issues().orderBy("place").collect()
    levels = [("critical", "warning", "info").index(r["severity"]) for r in placed]
    assert levels == sorted(levels)
    assert [r["place"] for r in placed] == list(range(1, len(placed) + 1))


def test_empty_table(spark):
    scan = scan_of(spark, [], "a int, b string")
    assert scan.scores().first().asDict() == {
        "overall": 100.0, "completeness": 100.0, "consistency": 100.0, "accuracy": 100.0, "distribution": 100.0,
        "label_quality": 100.0,
    }
    assert scan.issues().count() == 0
    assert scan.profiles().count() == 2


def test_few_values_and_constant_columns_have_no_outliers(spark):
    nine = [(float(i), 1.0) for i in range(8)] + [(1e9, 1e9)]
    assert not found(scan_of(spark, nine, "few double, x double"))
    constant = [(5.0,)] * 30 + [(1e9,)]
    assert ("x", "outliers", "accuracy") not in found(scan_of(spark, constant, "x double"))


def test_digits_count_as_lower_and_upper(spark):
    rows = [(str(i),) for i in range(20)]
    facts = profile.facts(spark.createDataFrame(rows, "v string"), ("case",))
    row = quality.mixed_case(facts).first()
    assert (row["lower_n"], row["upper_n"], row["mixed_n"], row["flagged"]) == (20, 20, -20, False)


def test_case_counts_agree_with_and_without_value_counts(spark):
    df = spark.createDataFrame([("Ab",), ("ab",), ("AB",), (None,), ("7",)] * 5, "v string")
    a = profile.facts(df, ("case",)).first()
    b = profile.facts(df, ("case", "values")).first()
    assert (a["lower_n"], a["upper_n"]) == (b["lower_n"], b["upper_n"]) == (10, 10)


def test_label_columns(spark):
    frame = lambda ddl: spark.createDataFrame([], ddl)
    assert profile.label_columns(frame("Target string, a int, class int")) == ["Target", "class"]
    assert profile.label_columns(frame("a int, b string")) == ["b"]
    assert profile.label_columns(frame("a int, b boolean")) == ["b"]
    assert profile.label_columns(frame("a string, b int")) == []


def test_null_counts_as_a_value_and_ties_go_by_value(spark):
    facts = profile.facts(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), ("values",))
    row = quality.string_profile(facts).first()
    assert (row["unique"], row["unique_count"], row["most_common"]) == (2, 3, "a")


@pytest.mark.parametrize("parts", [1, 8])
def test_partitions_do_not_matter(spark, small, parts):
    df = spark.read.parquet(f"{small}/orders.parquet").repartition(parts)
    scan = quality.Scan(df)
    assert scan.scores().first()["overall"] == quality.Scan(df.orderBy(F.desc("o_orderkey"))).scores().first()["overall"]


def test_wide_tables_are_taken_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(profile, "MOST_COLUMNS_PER_AGGREGATE", 2)
    df = spark.range(30).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(5)])
    got = {r["column"]: (r["min"], r["max"]) for r in profile.facts(df).collect()}
    assert got == {f"c{i}": (float(i), float(i + 29)) for i in range(5)}


def test_jobs_do_not_grow_with_columns(spark):
    context = spark.sparkContext

    def jobs(columns):
        df = spark.range(200).select(
            *[(F.col("id") % (7 + i)).alias(f"n{i}") for i in range(columns)],
            *[F.concat(F.lit("v"), F.col("id") % (3 + i)).alias(f"s{i}") for i in range(columns)],
        )
        group = f"facts over {columns}"
        context.setJobGroup(group, group)
        profile.facts(df)
        profile.duplicates(df).first()
        context.setJobGroup("other", "other")
        return len(context.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(12)


def test_copies_with_maps(spark):
    df = spark.sql("SELECT 1 AS a, map('x', 1, 'y', 2) AS m UNION ALL SELECT 1, map('y', 2, 'x', 1) UNION ALL SELECT 1, map('x', 3) UNION ALL SELECT 1, NULL")
    from sluice.operators import cleaning, profile

    assert tuple(profile.duplicates(df).first()) == (4, 1)
    assert cleaning.drop_duplicates(df).count() == 3 and cleaning.drop_duplicates(df).columns == ["a", "m"]
