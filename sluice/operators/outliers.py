"""Rows that several columns call odd: each column by the method that suits its shape, each row by the votes of its columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.quantiles import from_sketches, sketches
from sluice.functions.types import is_numeric
from sluice.operators.profile import FENCE, MIN_VALUES_FOR_FENCE
from sluice.session import small_frame

QUARTILES = (0.25, 0.75)
MOST_SKEW, MOST_TAILS = 0.5, 1.0  # of a column that counts as normal: skewness, and kurtosis beyond 3
MOST_DEVIATIONS = 3.0
METHODS = "column string, method string, low double, high double, n bigint"


def _shape(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, float | None, float | None, int]]:
    """Method and bounds per column: one aggregate for moments and sketches, and what it takes to read the quartiles off."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    facts = [f(number(c)).alias(f"{kind}:{c}") for c in columns for kind, f in (("mean", F.avg), ("std", F.stddev_pop), ("skew", F.skewness), ("tails", F.kurtosis))]
    row = df.agg(*sketches(columns, QUARTILES), *facts).first().asDict()  # one row, as wide as the schema
    quartiles = from_sketches(df, columns, QUARTILES, row)
    out = {}
    for c in columns:
        n, q = quartiles[c]
        mean, std, skew, tails = (row[f"{k}:{c}"] for k in ("mean", "std", "skew", "tails"))
        if n < MIN_VALUES_FOR_FENCE or not std:
            out[c] = ("none", None, None, n)
        elif abs(skew) <= MOST_SKEW and abs(tails) <= MOST_TAILS:
            out[c] = ("z-score", mean - MOST_DEVIATIONS * std, mean + MOST_DEVIATIONS * std, n)
        elif q[0] == q[1]:
            out[c] = ("none", None, None, n)
        else:
            out[c] = ("fences", q[0] - FENCE * (q[1] - q[0]), q[1] + FENCE * (q[1] - q[0]), n)
    return out


def methods(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column``, ``method`` (z-score for a nearly normal shape, else fences, none for constant or few values) and its bounds."""
    columns = [c for c in columns or df.columns if is_numeric(df.schema[c].dataType)]
    return small_frame(df.sparkSession, [(c, *facts) for c, facts in _shape(df, columns).items()], METHODS)


def votes(df: DataFrame, columns: Sequence[str] | None = None, least: int = 2) -> DataFrame:
    """The rows that at least ``least`` columns call odd, with their ``votes`` and the columns that cast them. Nulls cast none."""
    columns = [c for c in columns or df.columns if is_numeric(df.schema[c].dataType)]
    flags: list[Column] = [
        F.when((F.col(f"`{c}`") < low) | (F.col(f"`{c}`") > high), F.lit(c)) for c, (method, low, high, _) in _shape(df, columns).items() if method != "none"
    ]
    cast = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return df.withColumn("voters", cast).withColumn("votes", F.size("voters")).where(F.col("votes") >= least).withColumn("voters", F.concat_ws(",", "voters"))
