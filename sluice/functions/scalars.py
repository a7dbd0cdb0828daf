"""One-row aggregates as scalar subqueries: lazy, and no row passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(df: DataFrame, expression: Column) -> Column:
    """The value of an aggregate over the whole of ``df``."""
    return df.agg(expression.alias("value")).scalar()


def beside(one: DataFrame, *others: DataFrame) -> DataFrame:
    """The columns of other one-row frames next to those of a one-row frame, as scalar subqueries."""
    for other in others:
        row = other.select(F.struct(*other.columns)).scalar()
        one = one.select("*", *[row[c].alias(c) for c in other.columns])
    return one


def mean_of(df: DataFrame, column: str) -> Column:
    return scalar(df, F.avg(F.col(column).cast("double")))


def mode_of(df: DataFrame, column: str) -> Column:
    """The most frequent non-null value, the smallest one on a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return scalar(counts, F.min(F.struct((-F.col("n")).alias("n"), F.col("v")))["v"])
