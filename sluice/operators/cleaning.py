"""Repairs for the issues a quality scan finds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.draws import wide_draw
from sluice.functions.quantiles import quantiles
from sluice.functions.ranks import lowest_draws, rank_by_draw, take_ranks
from sluice.functions.scalars import beside, mean_of, mode_of
from sluice.functions.types import comparable, is_numeric
from sluice.operators import profile

SEED = 42

METHODS = {
    "duplicate_rows": "drop_exact_duplicates",
    "mixed_case": "lowercase_standardise",
}


def _null_method(df: DataFrame, column: str) -> str:
    return "mean_imputation" if is_numeric(df.schema[column].dataType) else "mode_imputation"


def preview(df: DataFrame, issues: Sequence[dict]) -> DataFrame:
    """For each issue the repair that would be made and the rows it concerns.

    All column issues are counted in one aggregate; copies need one grouping.
    """
    counts, entries = [], []
    copies = False
    for i, issue in enumerate(issues):
        kind, column = issue["issue_type"], issue.get("column_name")
        method, affected = METHODS.get(kind, "no_op"), F.lit(0).cast("bigint")
        if kind in ("null_values", "null_labels") and column:
            method, affected = _null_method(df, column), F.col(f"n{i}")
            counts.append(F.count_if(F.col(column).isNull()).alias(f"n{i}"))
        elif kind == "mixed_case" and column:
            c = F.col(column)
            affected = F.col(f"n{i}")
            counts.append(F.count_if((F.lower(c) != c) & (F.upper(c) != c)).alias(f"n{i}"))
        elif kind == "duplicate_rows":
            copies, affected = True, F.col("copies")
        elif kind == "mixed_case":
            method = "no_op"
        entries.append(
            F.struct(
                F.lit(i).alias("issue_no"), F.lit(kind).alias("issue_type"), F.lit(column).cast("string").alias("column_name"),
                F.lit(method).alias("method"), affected.alias("rows_affected"),
            )
        )
    one = df.agg(*(counts or [F.lit(0).alias("none")]))
    if copies:
        one = beside(one, profile.duplicates(df).select("copies"))
    return one.select(F.inline(F.array(*entries)))


# --- single repairs -----------------------------------------------------------


def fill_nulls(df: DataFrame, column: str) -> DataFrame:
    """Mean for numbers, which become doubles; otherwise the most frequent value."""
    if is_numeric(df.schema[column].dataType):
        return df.withColumn(column, F.coalesce(F.col(column).cast("double"), mean_of(df, column)))
    return df.withColumn(column, F.coalesce(F.col(column), mode_of(df, column)))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; maps are equal if their entries are."""
    names, entries = comparable(df)
    return df.withColumns(entries).dropDuplicates(names).drop(*entries)


def lower_case(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lower(column))


def column_fences(df: DataFrame, column: str) -> tuple[float, float] | None:
    found = quantiles(df, [column], [0.25, 0.75]).first()  # one row
    if found is None or not found["q"]:
        return None
    return profile.fences(found["q"][0], found["q"][1], found["n"])


def winsorise(df: DataFrame, column: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Pull values beyond the fences back onto them; nulls stay null."""
    bounds = bounds or column_fences(df, column)
    if bounds is None:
        return df
    value = F.col(column).cast("double")
    return df.withColumn(column, F.when(value < bounds[0], bounds[0]).when(value > bounds[1], bounds[1]).otherwise(value))


class ClassSizes:
    """Smallest and largest class of a column; ties go by value."""

    def __init__(self, df: DataFrame, column: str):
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(
            F.min(F.struct("n", "v")).alias("low"), F.max(F.struct("n", "v")).alias("high"), F.count(F.lit(1)).alias("k")
        ).first()
        self.classes = row["k"]
        self.minority, self.smallest = (row["low"]["v"], row["low"]["n"]) if self.classes else (None, 0)
        self.majority, self.largest = (row["high"]["v"], row["high"]["n"]) if self.classes else (None, 0)
        self.gap = self.largest - self.smallest if self.classes > 1 else 0


def oversample(df: DataFrame, column: str, key: str, seed: int = SEED, sizes: ClassSizes | None = None) -> DataFrame:
    """Append rows of the rarest class, drawn with replacement, up to the largest class.

    Draw number i takes the row whose rank is ``wide_draw(i) mod size``.
    """
    sizes = sizes or ClassSizes(df, column)
    if sizes.gap <= 0:
        return df
    rare = rank_by_draw(df.where(F.col(column) == F.lit(sizes.minority)), [column], key, seed, "__rank")
    picks = df.sparkSession.range(sizes.gap).select(
        F.col("id").alias("__pick"), (F.pmod(wide_draw(F.col("id"), seed), F.lit(sizes.smallest)) + 1).alias("__rank")
    )
    return df.unionByName(take_ranks(picks, rare, sizes.smallest, sizes.gap).select(*df.columns))


def undersample(df: DataFrame, column: str, key: str, seed: int = SEED, sizes: ClassSizes | None = None) -> DataFrame:
    """Thin the largest class to the size of the rarest; rows without a class are dropped."""
    sizes = sizes or ClassSizes(df, column)
    if sizes.gap <= 0:
        return df
    kept = lowest_draws(df.where(F.col(column) == F.lit(sizes.majority)), key, seed, sizes.smallest)
    return df.where(F.col(column) != F.lit(sizes.majority)).unionByName(kept)


# --- several repairs ----------------------------------------------------------


def _one_row(spark, value: int) -> DataFrame:
    return spark.range(1).select(F.lit(value).cast("bigint").alias("rows_changed"))


def apply_fix(df: DataFrame, issue: dict, key: str, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired frame and one row saying how many rows it changes."""
    kind, column = issue["issue_type"], issue.get("column_name")
    spark = df.sparkSession
    if kind in ("null_values", "null_labels") and column:
        return fill_nulls(df, column), df.agg(F.count_if(F.col(column).isNull()).alias("rows_changed"))
    if kind == "duplicate_rows":
        return drop_duplicates(df), profile.duplicates(df).select(F.col("copies").alias("rows_changed"))
    if kind == "mixed_case" and column:
        return lower_case(df, column), df.agg(F.count_if(F.col(column) != F.lower(column)).alias("rows_changed"))
    if kind == "outliers" and column:
        bounds = column_fences(df, column)
        if bounds is None:
            return df, _one_row(spark, 0)
        beyond = (F.col(column) < bounds[0]) | (F.col(column) > bounds[1])
        return winsorise(df, column, bounds), df.agg(F.count_if(beyond).alias("rows_changed"))
    if kind == "class_imbalance" and column:
        sizes = ClassSizes(df, column)
        thin = (options or {}).get("method", "oversample") == "undersample"
        balanced = (undersample if thin else oversample)(df, column, key, sizes=sizes)
        return balanced, _one_row(spark, max(0, sizes.gap))
    return df, _one_row(spark, 0)


def apply_fixes(
    df: DataFrame, issues: Sequence[dict], key: str, options: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """Repairs in sequence over one lineage, and a log with the rows each changed."""
    log = []
    for i, issue in enumerate(issues):
        df, changed = apply_fix(df, issue, key, options)
        log.append(
            changed.select(
                F.lit(i).alias("fix_no"), F.lit(issue["issue_type"]).alias("issue_type"),
                F.lit(issue.get("column_name")).cast("string").alias("column_name"), F.col("rows_changed").cast("bigint"),
            )
        )
    return df, reduce(DataFrame.unionByName, log)


def mark_resolved(issues: DataFrame, log: DataFrame) -> DataFrame:
    """Set the status of every issue whose repair was applied."""
    done = log.select(
        F.col("issue_type").alias("__type"), F.col("column_name").alias("__column"), F.lit("resolved").alias("__status")
    ).distinct()
    same = (F.col("issue_type") == F.col("__type")) & F.col("column_name").eqNullSafe(F.col("__column"))
    return issues.join(done, same, "left").select(
        *[F.coalesce("__status", "status").alias(c) if c == "status" else F.col(c) for c in issues.columns]
    )
