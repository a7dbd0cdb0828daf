"""Issues, scores and column profiles, derived from column facts.

Everything here is an expression over ``profile.facts`` and
``profile.duplicates``, a few rows each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scalars import beside
from sluice.operators import profile
from sluice.session import small_frame

# Weight of each dimension in the overall score.
WEIGHTS = {
    "completeness": 0.25,
    "consistency": 0.20,
    "accuracy": 0.25,
    "distribution": 0.20,
    "label_quality": 0.10,
}
SEVERITIES = ("critical", "warning", "info")
COLUMN_WEIGHT = {"critical": 15, "warning": 8, "info": 3}

ISSUE_COLUMNS = (
    "id", "column_name", "issue_type", "dimension", "severity", "description", "affected_count",
    "affected_pct", "impact_score", "fix_available", "fix_type", "status",
)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def severity(pct: Column) -> Column:
    return F.when(pct >= 15, "critical").when(pct >= 5, "warning").otherwise("info")


def _at_most(value: Column, top: float) -> Column:
    return F.least(value.cast("double"), F.lit(float(top)))


def _score(penalty: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 100 - penalty), 1)


def _issues(
    source: DataFrame, column: Column, kind: str, dimension: str, level: Column, text: Column, count: Column,
    pct: Column, impact: Column, fix: str | None,
) -> DataFrame:
    key = F.concat_ws("|", column, F.lit(kind), F.lit(dimension))
    return source.select(
        F.substring(F.md5(key), 1, 16).alias("id"),
        column.alias("column_name"),
        F.lit(kind).alias("issue_type"),
        F.lit(dimension).alias("dimension"),
        level.alias("severity"),
        text.alias("description"),
        count.cast("bigint").alias("affected_count"),
        F.round(pct, 3).alias("affected_pct"),
        F.round(impact, 2).alias("impact_score"),
        F.lit(fix is not None).alias("fix_available"),
        F.lit(fix).cast("string").alias("fix_type"),
        F.lit("open").alias("status"),
    )


def _null_pct() -> Column:
    return percent(F.col("nulls"), F.col("rows"))


def _present() -> Column:
    return F.col("rows") - F.col("nulls")


def _mixed() -> Column:
    return _present() - F.col("lower_n") - F.col("upper_n")


def _ratio() -> Column:
    return F.col("top_n") / F.greatest(F.col("bottom_n"), F.lit(1))


# --- completeness -----------------------------------------------------------


def null_census(facts: DataFrame) -> DataFrame:
    return facts.select(
        "column",
        F.col("nulls").alias("null_count"),
        F.round(_null_pct(), 3).alias("null_pct"),
        severity(_null_pct()).alias("severity"),
        F.round(_at_most(_null_pct() * 0.8, 20), 2).alias("impact_score"),
    )


def null_issues(facts: DataFrame) -> DataFrame:
    hit = facts.where(F.col("nulls") > 0)
    text = F.format_string("%.1f%% null values in '%s'", _null_pct(), F.col("column"))
    return _issues(
        hit, F.col("column"), "null_values", "completeness", severity(_null_pct()), text, F.col("nulls"),
        _null_pct(), _at_most(_null_pct() * 0.8, 20), "auto",
    )


def _completeness() -> Column:
    kept = F.avg(F.greatest(F.lit(0.0), 100 - _null_pct() * 1.5))
    return F.round(F.coalesce(kept, F.lit(100.0)), 1).alias("completeness")


def completeness(facts: DataFrame) -> DataFrame:
    return facts.agg(_completeness())


# --- consistency ------------------------------------------------------------


def _is_mixed() -> Column:
    return (F.col("kind") == "string") & (_present() >= 10) & (_mixed() > 0) & (_mixed() / _present() > 0.05)


def duplicate_issues(duplicates: DataFrame) -> DataFrame:
    pct = percent(F.col("copies"), F.col("rows"))
    text = F.format_string("%s exact duplicate rows (%.1f%%)", F.format_number("copies", 0), pct)
    return _issues(
        duplicates.where(F.col("copies") > 0), F.lit(None).cast("string"), "duplicate_rows", "consistency",
        severity(pct), text, F.col("copies"), pct, _at_most(pct * 0.5, 10), "auto",
    )


def mixed_case(facts: DataFrame) -> DataFrame:
    """Per text column the values that are neither all lower nor all upper case."""
    flagged = _is_mixed()
    return facts.where(F.col("kind") == "string").select(
        "column", _present().alias("non_null"), "lower_n", "upper_n", _mixed().alias("mixed_n"), flagged.alias("flagged")
    )


def mixed_case_issues(facts: DataFrame) -> DataFrame:
    pct = _mixed() / _present() * 100
    text = F.format_string("Mixed case values in '%s' (%.1f%% inconsistent)", F.col("column"), pct)
    return _issues(
        facts.where(_is_mixed()), F.col("column"), "mixed_case", "consistency", F.lit("info"), text, _mixed(), pct,
        F.lit(1.0), "auto",
    )


def _consistency() -> Column:
    return _score(percent(F.col("copies"), F.col("rows")) * 2 + F.col("mixed") * 2).alias("consistency")


def consistency(facts: DataFrame, duplicates: DataFrame) -> DataFrame:
    return beside(duplicates, facts.agg(F.count_if(_is_mixed()).alias("mixed"))).select(_consistency())


# --- accuracy ---------------------------------------------------------------


def _out_pct() -> Column:
    return percent(F.col("outliers"), F.col("rows"))


def outlier_issues(facts: DataFrame) -> DataFrame:
    text = F.format_string(
        "%s outliers in '%s' (%.1f%%), beyond the 3x IQR fence", F.format_number("outliers", 0), F.col("column"), _out_pct()
    )
    return _issues(
        facts.where(F.col("outliers") > 0), F.col("column"), "outliers", "accuracy", severity(_out_pct()), text,
        F.col("outliers"), _out_pct(), _at_most(_out_pct() * 0.7, 10), "semi_auto",
    )


def outliers(facts: DataFrame) -> DataFrame:
    """Per numeric column the quartiles and how many values lie beyond the fences."""
    return facts.where(F.col("kind") == "numeric").select(
        "column", "numbers", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "outliers",
        F.round(_out_pct(), 3).alias("outlier_pct"), severity(_out_pct()).alias("severity"),
    )


def _accuracy() -> Column:
    penalty = F.when(F.col("outliers") > 0, _at_most(_out_pct() * 1.2, 15)).otherwise(F.lit(0.0))
    return _score(F.coalesce(F.avg(penalty), F.lit(0.0))).alias("accuracy")


def accuracy(facts: DataFrame) -> DataFrame:
    return facts.agg(_accuracy())


# --- distribution -----------------------------------------------------------


def _skewed() -> Column:
    return (F.col("numbers") >= 20) & (F.col("std") > 0) & (F.abs("skew") > 2)


def _dominated() -> Column:
    several = (F.col("kind") == "string") & (_present() >= 10) & (F.col("distinct_n") > 1)
    return several & (F.col("top_n") / _present() * 100 > 90)


def skew_issues(facts: DataFrame) -> DataFrame:
    text = F.format_string("High skewness (%.2f) in '%s', consider a log transform", F.col("skew"), F.col("column"))
    return _issues(
        facts.where(_skewed()), F.col("column"), "high_skew", "distribution", F.lit("info"), text, F.col("numbers"),
        F.lit(100.0), F.lit(2.0), None,
    )


def skewness(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "numeric").select(
        "column", "numbers", F.round("skew", 4).alias("skew"), F.coalesce(_skewed(), F.lit(False)).alias("flagged")
    )


def imbalance(facts: DataFrame) -> DataFrame:
    """Text columns in which one value makes up more than 90 % of the non-null ones."""
    return facts.where(_dominated()).select(
        "column", "top_n", "bottom_n", F.round(F.col("top_n") / _present() * 100, 4).alias("top_pct"),
        F.round(_ratio(), 4).alias("ratio"),
    )


def imbalance_issues(facts: DataFrame) -> DataFrame:
    text = F.format_string(
        "Severe class imbalance in '%s', dominant class %.1f%% (ratio %.0f:1)",
        F.col("column"), F.col("top_n") / _present() * 100, _ratio(),
    )
    return _issues(
        facts.where(_dominated()), F.col("column"), "class_imbalance", "distribution", F.lit("warning"), text,
        F.col("rows"), F.lit(100.0), F.lit(8.0), None,
    )


def _distribution() -> Column:
    penalty = F.when(_skewed(), 5.0).when(_dominated(), 8.0)  # mean over flagged columns only
    return _score(F.coalesce(F.avg(penalty), F.lit(0.0))).alias("distribution")


def distribution(facts: DataFrame) -> DataFrame:
    return facts.agg(_distribution())


# --- label quality ----------------------------------------------------------


def _lopsided() -> Column:
    return (F.col("kind") == "string") & (F.col("distinct_n") > 1) & (_ratio() > 10)


def label_nulls(facts: DataFrame) -> DataFrame:
    return facts.where("is_label").select(
        "column", F.col("nulls").alias("null_count"), F.round(_null_pct(), 3).alias("null_pct"),
        F.when(_null_pct() > 5, "critical").otherwise("warning").alias("severity"),
        F.round(_at_most(_null_pct() * 2, 30), 4).alias("penalty"),
        F.round(_at_most(_null_pct() * 1.2, 20), 2).alias("impact_score"),
    )


def label_null_issues(facts: DataFrame) -> DataFrame:
    text = F.format_string("%.1f%% null values in label column '%s'", _null_pct(), F.col("column"))
    return _issues(
        facts.where(F.col("is_label") & (F.col("nulls") > 0)), F.col("column"), "null_labels", "label_quality",
        F.when(_null_pct() > 5, "critical").otherwise("warning"), text, F.col("nulls"), _null_pct(),
        _at_most(_null_pct() * 1.2, 20), "semi_auto",
    )


def label_imbalance(facts: DataFrame) -> DataFrame:
    return facts.where("is_label").select(
        "column", F.col("distinct_n").alias("classes"), "top_n", "bottom_n", F.round(_ratio(), 4).alias("ratio"),
        F.coalesce(_lopsided(), F.lit(False)).alias("flagged"),
    )


def label_imbalance_issues(facts: DataFrame) -> DataFrame:
    text = F.format_string("Label imbalance in '%s', %.0f:1 ratio between classes", F.col("column"), _ratio())
    return _issues(
        facts.where(F.col("is_label") & _lopsided()), F.col("column"), "class_imbalance", "label_quality",
        F.lit("warning"), text, F.col("rows"), F.lit(100.0), _at_most(_ratio() * 0.3, 15), None,
    )


def _label_quality() -> Column:
    missing = F.when(F.col("is_label") & (F.col("nulls") > 0), _at_most(_null_pct() * 2, 30))
    lopsided = F.when(F.col("is_label") & _lopsided(), F.lit(10.0))
    total = F.coalesce(F.sum(missing), F.lit(0.0)) + F.coalesce(F.sum(lopsided), F.lit(0.0))
    number = F.count(missing) + F.count(lopsided)
    return _score(F.when(number > 0, total / number).otherwise(F.lit(0.0))).alias("label_quality")


def label_quality(facts: DataFrame) -> DataFrame:
    return facts.agg(_label_quality())


# --- together ---------------------------------------------------------------


def issues(facts: DataFrame, duplicates: DataFrame) -> DataFrame:
    found = [
        null_issues(facts), duplicate_issues(duplicates), mixed_case_issues(facts), outlier_issues(facts),
        skew_issues(facts), imbalance_issues(facts), label_null_issues(facts), label_imbalance_issues(facts),
    ]
    return reduce(DataFrame.unionByName, found)


def ranked(issues: DataFrame) -> DataFrame:
    """Issues by severity, then impact; ``place`` makes the order part of the data."""
    order = Window.orderBy(  # a few issues per column, never data-sized
        F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")),
        F.col("impact_score").desc(),
        F.col("column_name").asc_nulls_first(),
        "issue_type",
        "dimension",
    )
    return issues.withColumn("place", F.row_number().over(order))


def scores(facts: DataFrame, duplicates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: the five dimension scores and their weighted sum."""
    over_columns = facts.agg(
        _completeness(), _accuracy(), _distribution(), _label_quality(), F.count_if(_is_mixed()).alias("mixed")
    )
    both = beside(over_columns, duplicates).withColumn("consistency", _consistency())
    total = reduce(lambda a, b: a + b, [F.col(name) * F.lit(w) for name, w in (weights or WEIGHTS).items()])
    return both.select(F.round(total, 1).alias("overall"), *WEIGHTS)


def weighted_score(scan_scores: DataFrame, columns: DataFrame, weights: dict[str, float], critical: Sequence[tuple[str, float, float]] = ()) -> DataFrame:
    """One row: ``base`` (dimension scores under ``weights``, scaled to their sum), ``penalty`` and ``final``, from 0 to 100.

    ``critical`` lists columns (name, least score, points): a column that scores
    below its least costs its points, in proportion to how far it falls short; one
    that is not there costs them all.
    """
    unknown = set(weights) - set(WEIGHTS)
    if unknown or not sum(weights.values()) > 0:
        raise ValueError(f"weights are needed for some of {sorted(WEIGHTS)}, got {sorted(weights)}")
    total = reduce(lambda a, b: a + b, [F.col(name) * F.lit(float(w)) for name, w in weights.items()]) / float(sum(weights.values()))
    rules = small_frame(scan_scores.sparkSession, [(c, float(least), float(points)) for c, least, points in critical], "name string, least double, points double")
    met = rules.join(columns.select(F.col("column").alias("name"), "quality_score"), "name", "left")  # a row per rule
    short = F.when(F.col("least") > 0, F.greatest(F.lit(0.0), F.col("least") - F.coalesce("quality_score", F.lit(0.0))) / F.col("least")).otherwise(0.0)
    lost = met.agg(F.round(F.coalesce(F.sum(F.col("points") * short), F.lit(0.0)), 2).alias("penalty"))
    both = beside(scan_scores.select(F.round(total, 1).alias("base")), lost)
    return both.withColumn("final", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base") - F.col("penalty"))), 1))


def column_scores(facts: DataFrame, issues: DataFrame) -> DataFrame:
    weight = F.when(F.col("severity") == "critical", 15).when(F.col("severity") == "warning", 8).otherwise(3)
    lost = issues.groupBy(F.col("column_name").alias("column")).agg(F.sum(weight).alias("lost"))
    score = F.greatest(F.lit(0.0), 100 - _null_pct() * 1.5 - F.coalesce(F.col("lost"), F.lit(0)))
    return facts.join(lost, "column", "left").select("column", F.round(score, 1).alias("quality_score"))


def numeric_profile(facts: DataFrame) -> DataFrame:
    stats = [F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std")]
    return facts.where((F.col("kind") == "numeric") & (F.col("numbers") > 0)).select("column", *stats)


def string_profile(facts: DataFrame) -> DataFrame:
    """Distinct values, the most common one, and the distinct count with null as a value."""
    distinct = F.coalesce(F.col("distinct_n"), F.lit(0))
    return facts.where(F.col("kind") == "string").select(
        "column", distinct.alias("unique"), F.col("top_value").alias("most_common"),
        (distinct + (F.col("nulls") > 0).cast("bigint")).alias("unique_count"),
    )


def column_profiles(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per column; nested parts as JSON text."""
    kept = ("issue_type", "severity", "affected_count", "impact_score")
    grouped = issues.groupBy(F.col("column_name").alias("column")).agg(
        F.array_sort(F.collect_list(F.struct(*kept))).alias("found")
    )
    share = lambda t: F.round(t["count"] / _present() * 100, 1)
    spread = F.transform("top", lambda t: F.struct(t["label"], t["count"], share(t).alias("pct")))
    numeric = F.struct(*[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std")])
    text = F.struct(F.coalesce(F.col("distinct_n"), F.lit(0)).alias("unique"), F.col("top_value").alias("most_common"))
    stats = F.when((F.col("kind") == "numeric") & (F.col("numbers") > 0), F.to_json(numeric)).when(
        F.col("kind") == "string", F.to_json(text)
    )
    unique = F.when(F.col("kind") == "string", F.coalesce(F.col("distinct_n"), F.lit(0)) + (F.col("nulls") > 0).cast("bigint"))
    return (
        facts.join(column_scores(facts, issues), "column")
        .join(grouped, "column", "left")
        .select(
            "ordinal", F.col("column").alias("name"), "dtype", F.col("nulls").alias("null_count"),
            F.round(_null_pct(), 3).alias("null_pct"), unique.alias("unique_count"), "quality_score",
            F.coalesce(F.to_json("found"), F.lit("[]")).alias("issues"),
            F.coalesce(F.to_json(spread), F.lit("[]")).alias("distribution"),
            F.coalesce(stats, F.lit("{}")).alias("stats"),
        )
    )


class Scan:
    """A full scan: the passes over the data run once, the rest is derived from their few rows."""

    def __init__(self, df: DataFrame, approximate: bool = False):
        spark = df.sparkSession
        self.facts = profile.facts(df, approximate=approximate)
        counted = profile.duplicates(df).first()
        self.duplicates = small_frame(spark, [tuple(counted)], "rows bigint, copies bigint")
        found = issues(self.facts, self.duplicates)
        self._issues = small_frame(spark, [tuple(r) for r in found.collect()], found.schema)  # a few per column

    def issues(self) -> DataFrame:
        return ranked(self._issues)

    def scores(self) -> DataFrame:
        return scores(self.facts, self.duplicates)

    def profiles(self) -> DataFrame:
        return column_profiles(self.facts, self._issues)


# --- scan history -----------------------------------------------------------


def latest_scans(history: DataFrame, dataset: str = "dataset_id", at: str = "created_at") -> DataFrame:
    """The newest scan of each dataset; an aggregate, so a dataset with most scans is no hot spot."""
    others = [c for c in history.columns if c not in (dataset, at)]
    newest = history.groupBy(dataset).agg(F.max(F.struct(at, *others)).alias("s"))
    return newest.select(dataset, "s.*").select(*history.columns)


def score_deltas(
    history: DataFrame, dataset: str = "dataset_id", at: str = "created_at", score: str = "score",
    order: Sequence[str] = (),
) -> DataFrame:
    """Per dataset the score of its last complete scan minus that of the one before.

    Spark keeps the two newest scans per dataset already before the shuffle.
    """
    done = history.where((F.col("status") == "complete") & F.col(score).isNotNull())
    newest = Window.partitionBy(dataset).orderBy(F.col(at).desc(), *[F.col(c).desc() for c in order])
    two = done.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= 2)
    nth = lambda n: F.max(F.when(F.col("place") == n, F.col(score)))
    return (
        two.groupBy(dataset)
        .agg(nth(1).alias("latest"), nth(2).alias("previous"))
        .withColumn("delta", F.col("latest") - F.col("previous"))
    )
