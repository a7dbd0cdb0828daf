"""Positions and ranks that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.draws import DRAW_RANGE, draw
from sluice.session import materialize, shuffle_buckets


def _placed(df: DataFrame, order: Sequence[Column | str], value: str | None = None) -> DataFrame:
    """Sorted rows with their partition, their place in it, and what the partitions before hold.

    Sort once by range and keep each row's place inside its sorted partition.
    The sorted rows are checkpointed, so that counting and placing see the same
    partitions. The only window runs over one row per partition.
    """
    slot = F.monotonically_increasing_id()
    placed = materialize(df.orderBy(*order).withColumn("__slot", slot)).withColumn("__part", F.shiftright("__slot", 33))
    amount = F.count(F.lit(1)) if value is None else F.sum(value)
    sizes = placed.groupBy("__part").agg(amount.alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return placed.join(F.broadcast(shifts), "__part")  # one row per partition


def ordered_index(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Number all rows in a total order, from ``start``."""
    inside = F.col("__slot").bitwiseAND(F.lit((1 << 33) - 1))
    placed = _placed(df, order)
    return placed.select(*df.columns, (inside + F.col("__shift") + F.lit(start)).cast("bigint").alias(name))


def running_sum(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows up to and with this one in a total order."""
    upto = Window.partitionBy("__part").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = _placed(df, order, value)
    return placed.select(*df.columns, (F.sum(value).over(upto) + F.col("__shift")).alias(name))


def number_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 1 by ``order``, which must be total within a group.

    All rows are numbered together, then each group is moved back to 1, so a
    group that holds most of the table is still sorted by many tasks.
    """
    indexed = ordered_index(df, [*groups, *order], "__index")
    first = indexed.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.min("__index").alias("__first"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return indexed.join(first, same).select(*df.columns, (F.col("__index") - F.col("__first") + 1).alias(name))


def rank_by_draw(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    seed: int | str,
    name: str,
    group_size: str | None = None,
) -> DataFrame:
    """Rank the rows of each group by their draw, from 1; nulls form a group.

    Draws are uniform, so slicing their range splits even a group that holds
    most of the table into equal slices. Rows are ranked inside a slice and
    shifted by the rows of lower slices of the same group.
    """
    buckets = shuffle_buckets(df.sparkSession)
    drawn = df.withColumn("__draw", draw(key, seed)).withColumn(
        "__slice", F.floor(F.col("__draw") * F.lit(buckets) / F.lit(DRAW_RANGE)).cast("int")
    )
    lower = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    shifts = (
        drawn.groupBy(*groups, "__slice")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
            F.col("__slice").alias("__s"),
            F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__shift"),
            F.sum("__n").over(whole).alias("__size"),
        )
    )
    same = F.col("__slice") == F.col("__s")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*groups, "__slice").orderBy("__draw", key)
    ranked = drawn.join(shifts, same).withColumn(
        name, (F.row_number().over(within) + F.col("__shift")).cast("bigint")
    )
    if group_size:
        ranked = ranked.withColumn(group_size, F.col("__size"))
    return ranked.select(*df.columns, name, *([group_size] if group_size else []))


def take_ranks(picks: DataFrame, ranked: DataFrame, size: int, n: int, rank: str = "__rank") -> DataFrame:
    """Join ``n`` drawn ranks (with the draw's number ``__pick``) with the ``size`` rows that hold them.

    Each of few rows may be drawn very often, so rows are repeated over salts,
    as often as a row is drawn on average and never beyond ``SALTS``.
    """
    salts = max(1, min(SALTS, n // max(size, 1)))
    salted = ranked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return picks.withColumn("__salt", F.pmod(F.xxhash64("__pick"), F.lit(salts)).cast("int")).join(salted, [rank, "__salt"]).drop("__salt")


SALTS = 64
FINE_SLICES = 65_536


def lowest_draws(df: DataFrame, key: str, seed: int | str, k: int) -> DataFrame:
    """Exactly the ``k`` rows with the smallest draws: a sample without replacement.

    One small count per slice of the draw range finds the slice in which the
    sample ends, a second one the draw within that slice. Rows with lower draws
    are kept where they are, without a shuffle; only rows of that one draw are
    sorted, one in four thousand million.
    """
    if k <= 0:
        return df.limit(0)
    width = DRAW_RANGE // FINE_SLICES
    drawn = df.withColumn("__draw", draw(key, seed))
    slices = drawn.groupBy(F.floor(F.col("__draw") / F.lit(width)).alias("at"))
    cut, left = _ends_at(slices.agg(F.count(F.lit(1)).alias("n")), k)
    if cut is None:
        return df
    inside = drawn.where(F.floor(F.col("__draw") / F.lit(width)) == cut)
    last, left = _ends_at(inside.groupBy(F.col("__draw").alias("at")).agg(F.count(F.lit(1)).alias("n")), left)
    below = drawn.where(F.col("__draw") < last)
    edge = drawn.where(F.col("__draw") == last).orderBy(key).limit(left)
    return below.unionByName(edge).select(*df.columns)


def _ends_at(counts: DataFrame, k: int) -> tuple[int | None, int]:
    """Where counts (``at``, ``n``; at most ``FINE_SLICES`` rows) reach ``k``, and how many of that place are needed; None if they never do."""
    for row in counts.orderBy("at").collect():
        if row["n"] >= k:
            return row["at"], k
        k -= row["n"]
    return None, k
