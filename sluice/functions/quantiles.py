"""Exact interpolated quantiles with bounded work per task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sluice.session import small_frame

ACCURACY = 10_000
FEW = 3  # times the accuracy: so few values are taken whole
MOST_IN_A_BRACKET = 1_000_000  # rows; more than FEW * ACCURACY
MOST_PER_AGGREGATE = 100  # brackets counted by one aggregate


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], approximate: bool = False) -> DataFrame:
    """One row per column: ``column``, ``n`` (non-null) and ``q`` (array, as ``probs``).

    A sketch brackets each quantile within its guaranteed rank error, one wide
    aggregate counts the values below and inside each bracket, and the order
    statistics are read off the values inside. Brackets that hold too many values
    for one task are sketched again. ``approximate`` stops at the first sketch.
    """
    if approximate:
        return _sketched(_numbers(df, columns), columns, probs)
    row = df.agg(*sketches(columns, probs)).first()  # one row, as wide as the schema
    found = from_sketches(df, columns, probs, row.asDict())
    return small_frame(df.sparkSession, [(c, *found[c]) for c in columns], "column string, n bigint, q array<double>")


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def sketches(columns: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """Aggregates that bracket the quantiles of all columns; they may share a pass with others."""
    margin = 2.0 / ACCURACY
    edges = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    number = lambda c: F.col(f"`{c}`").cast("double")
    return [
        *[F.count(number(c)).alias(f"sketch:n:{c}") for c in columns],
        *[F.percentile_approx(number(c), edges, ACCURACY).alias(f"sketch:e:{c}") for c in columns],
    ]


def from_sketches(df: DataFrame, columns: Sequence[str], probs: Sequence[float], row: dict) -> dict[str, tuple[int, list[float] | None]]:
    """Per column the number of values and the exact quantiles, from a row of :func:`sketches`."""
    k, numbers = len(probs), _numbers(df, columns)
    sizes = [row[f"sketch:n:{c}"] for c in columns]
    # a margin of few ranks might miss one of the two values around a quantile, so few values are taken whole
    ends = [row[f"sketch:e:{c}"] if n > FEW * ACCURACY else [-math.inf] * k + [math.inf] * k for c, n in zip(columns, sizes)]
    brackets = [_Bracket(i, j, p * (n - 1), ends[i][j], ends[i][k + j]) for i, n in enumerate(sizes) if n for j, p in enumerate(probs)]
    _narrow(numbers, brackets)
    read = {(r["col"], r["prob"]): (r["lo"], r["hi"]) for r in _order_statistics(numbers, [b for b in brackets if b.low < b.high])}
    values: dict[int, list[float]] = {}
    for b in brackets:
        lo, hi = read.get((b.col, b.prob), (b.low, b.low))  # where both ends agree there is one value
        part = b.spot - math.floor(b.spot)
        values.setdefault(b.col, []).append(lo if part == 0 else (1 - part) * lo + part * hi)
    return {c: (n, values.get(i)) for i, (c, n) in enumerate(zip(columns, sizes))}


def _sketched(numbers: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    wide = numbers.agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.percentile_approx(f"c{i}", [float(p) for p in probs], ACCURACY).alias(f"q{i}") for i in range(len(columns))],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"q{i}").alias("q"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


@dataclass
class _Bracket:
    """Where the quantile ``prob`` of column ``col`` lies: at rank ``spot`` (from 0) between ``low`` and ``high``, with ``below`` smaller values."""

    col: int
    prob: int
    spot: float
    low: float
    high: float
    below: int = 0
    inside: int = 0
    settled: bool = False  # a narrower bracket cannot be had

    def holds(self) -> Column:
        return F.col(f"c{self.col}").between(self.low, self.high)


def _narrow(numbers: DataFrame, brackets: Sequence[_Bracket]) -> None:
    """Count what lies below and inside every bracket; sketch again inside those that hold too many values."""
    margin = 2.0 / ACCURACY
    open_ones = [b for b in brackets if -math.inf < b.low < b.high]
    while open_ones:
        for at in range(0, len(open_ones), MOST_PER_AGGREGATE):
            block = open_ones[at : at + MOST_PER_AGGREGATE]
            counts = [F.count_if(F.col(f"c{b.col}") < b.low) for b in block] + [F.count_if(b.holds()) for b in block]
            row = numbers.agg(*[c.alias(str(i)) for i, c in enumerate(counts)]).first()
            for i, b in enumerate(block):
                b.below, b.inside = row[i], row[len(block) + i]
        open_ones = [b for b in open_ones if b.inside > MOST_IN_A_BRACKET and not b.settled]
        if open_ones:
            ends = []
            for b in open_ones:
                p = (b.spot - b.below) / max(1, b.inside - 1)
                at = [min(1.0, max(0.0, p - margin)), min(1.0, max(0.0, p + margin))]
                ends.append(F.percentile_approx(F.when(b.holds(), F.col(f"c{b.col}")), at, ACCURACY))
            row = numbers.agg(*[e.alias(str(i)) for i, e in enumerate(ends)]).first()
            for i, b in enumerate(open_ones):
                low, high = row[i]
                b.settled = (low, high) == (b.low, b.high)  # few values, each many times
                b.low, b.high = low, high
            open_ones = [b for b in open_ones if b.low < b.high]


def _order_statistics(numbers: DataFrame, brackets: Sequence[_Bracket]) -> list[Row]:
    """``col, prob, lo, hi``: the values at the ranks around each quantile. Only rows with a value inside a bracket are looked at."""
    if not brackets:
        return []
    within: dict[int, Column] = {}
    for b in brackets:
        within[b.col] = within[b.col] | b.holds() if b.col in within else b.holds()
    some = reduce(Column.__or__, within.values())
    hits = F.array(*[F.when(test, F.struct(F.lit(i).alias("col"), F.col(f"c{i}").alias("v"))) for i, test in within.items()])
    counted = numbers.where(some).select(F.inline(F.array_compact(hits))).groupBy("col", "v").agg(F.count(F.lit(1)).alias("m"))
    facts = small_frame(numbers.sparkSession, [(b.col, b.prob, b.spot, b.low, b.high, b.below) for b in brackets], "at int, prob int, spot double, low double, high double, below bigint")
    met = counted.join(F.broadcast(facts), (F.col("col") == F.col("at")) & F.col("v").between(F.col("low"), F.col("high")))  # a few per column
    upto = Window.partitionBy("col", "prob").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # at most MOST_IN_A_BRACKET values
    running = met.withColumn("upto", F.sum("m").over(upto) + F.col("below"))
    at_rank = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return running.groupBy("col", "prob").agg(at_rank(F.floor("spot")).alias("lo"), at_rank(F.ceil("spot")).alias("hi")).collect()
