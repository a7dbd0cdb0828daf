"""Why values are missing: completely at random, depending on other columns, or not to be told.

Every column's values are put into a few bins, missing ones into a bin of their
own. For every column with missing values and every other column, the bins of
rows with and without the value are compared by chi-square. One grouping counts
all pairs; its result has a few rows per pair of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.quantiles import quantiles
from sluice.functions.types import is_numeric, is_string
from sluice.operators import profile
from sluice.session import small_frame

QUARTILES = (0.25, 0.5, 0.75)
NAMED_VALUES = 10  # text values with a bin of their own
LEAST_ROWS = 30  # missing and present, to tell anything
LEAST_EXPECTED = 5.0  # rows a bin needs on either side to be compared
STRONG, SURE = 0.1, 3.09  # Cramer's V, and the normal score of a chance below one in a thousand


def _bins(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """The bin of each column's value: quarters of numbers, the most frequent texts; null where it is missing."""
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    texts = [c for c in columns if is_string(df.schema[c].dataType)]
    out: dict[str, Column] = {}
    for r in quantiles(df, numeric, QUARTILES).collect() if numeric else []:  # one row per column
        x = F.col(r["column"]).cast("double")
        bin_ = F.lit(0)
        for edge in sorted(set(r["q"] or ())):
            bin_ = bin_ + (x > edge).cast("int")
        out[r["column"]] = F.when(x.isNotNull(), F.concat(F.lit("q"), bin_.cast("string")))
    if texts:
        top = profile.top_values(profile.value_counts(df.select(*texts)), NAMED_VALUES)
        named: dict[str, list[str]] = {c: [] for c in texts}
        for r in top.select("column", "value").collect():  # ten per column
            named[r["column"]].append(r["value"])
        for c in texts:
            out[c] = F.when(F.col(c).isin(named[c]), F.concat(F.lit("="), F.col(c))).when(F.col(c).isNotNull(), F.lit("other"))
    return out


def associations(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """``column``, ``other``, ``nulls``, ``rows``, ``chi_square``, ``dof``, ``cramers_v``, ``score``.

    For every column with missing values and every other column: how far the other
    column's bins depend on the value being missing. ``score`` is chi-square on the
    scale of a normal variable (Wilson and Hilferty). Bins too rare to compare are
    thrown together.
    """
    columns = [c for c in columns or df.columns if is_numeric(df.schema[c].dataType) or is_string(df.schema[c].dataType)]
    bins = _bins(df, columns)
    cells = F.array(*[F.struct(F.lit(c).alias("other"), F.coalesce(bins[c], F.lit("missing")).alias("bin")) for c in columns])
    absent = F.array_compact(F.array(F.lit("*"), *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    long = df.select(F.explode(absent).alias("column"), cells.alias("cells")).select("column", F.inline("cells"))
    counted = long.groupBy("column", "other", "bin").agg(F.count(F.lit(1)).alias("m"))  # bins x pairs of columns
    whole = counted.where("column = '*'").select("other", "bin", F.col("m").alias("all"))
    without = counted.where("column <> '*' AND column <> other")
    sizes = without.groupBy("column", "other").agg(F.sum("m").alias("nulls"))
    grid = sizes.join(whole, "other").join(without, ["column", "other", "bin"], "left").select("column", "other", "bin", "nulls", "all", F.coalesce("m", F.lit(0)).alias("m"))
    rows = F.sum("all").over(Window.partitionBy("column", "other"))
    placed = grid.withColumn("rows", rows).withColumn("p", F.col("nulls") / F.col("rows"))
    rare = F.col("all") * F.least(F.col("p"), 1 - F.col("p")) < LEAST_EXPECTED
    merged = placed.groupBy("column", "other", "nulls", "rows", F.when(rare, F.lit("rare")).otherwise(F.concat(F.lit("bin "), F.col("bin"))).alias("bin")).agg(F.sum("all").alias("all"), F.sum("m").alias("m"))
    p = F.col("nulls") / F.col("rows")
    gap = F.col("m") - F.col("all") * p
    part = F.when((p > 0) & (p < 1), gap * gap / (F.col("all") * p) + gap * gap / (F.col("all") * (1 - p))).otherwise(0.0)
    tested = merged.groupBy("column", "other", "nulls", "rows").agg(F.sum(part).alias("x"), (F.count(F.lit(1)) - 1).alias("dof"))
    spread = 2 / (9 * F.col("dof"))
    score = F.when(F.col("dof") > 0, (F.cbrt(F.col("x") / F.col("dof")) - (1 - spread)) / F.sqrt(spread))
    return tested.select(
        "column", "other", "nulls", "rows", F.round("x", digits).alias("chi_square"), F.col("dof").cast("int").alias("dof"),
        F.round(F.sqrt(F.col("x") / F.col("rows")), digits).alias("cramers_v"), F.round(score, digits).alias("score"),
    )


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``column``, ``nulls``, ``kind``, and the column it depends on most with its ``cramers_v``.

    ``none`` is missing; ``MAR`` if another column tells which values are missing;
    ``MCAR`` if none does; ``unknown`` with too few missing or present values.
    Whether values are missing because of what they are cannot be seen in the data.
    """
    columns = [c for c in columns or df.columns if is_numeric(df.schema[c].dataType) or is_string(df.schema[c].dataType)]
    pairs = associations(df, columns)
    tells = (F.col("score") > SURE) & (F.col("cramers_v") >= STRONG)
    most = F.max(F.when(tells, F.struct("cramers_v", "other")))
    per_column = pairs.groupBy("column").agg(F.max("nulls").alias("nulls"), F.max("rows").alias("rows"), most.alias("most"))
    names = small_frame(df.sparkSession, [(c,) for c in columns], "column string")
    nulls = F.coalesce("nulls", F.lit(0)).cast("bigint")
    kind = (
        F.when(nulls == 0, "none").when(F.least(F.col("nulls"), F.col("rows") - F.col("nulls")) < LEAST_ROWS, "unknown")
        .when(F.col("most").isNotNull(), "MAR").otherwise("MCAR")
    )
    shown = F.when(kind == "MAR", F.col("most"))
    return names.join(per_column, "column", "left").select("column", nulls.alias("nulls"), kind.alias("kind"), shown["other"].alias("depends_on"), shown["cramers_v"].alias("cramers_v"))
