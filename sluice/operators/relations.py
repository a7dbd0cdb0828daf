"""Checks across tables, columns and versions of a dataset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.draws import uniform
from sluice.operators.evaluation import confusion
from sluice.session import materialize


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Referential integrity: rows of ``child`` whose non-null ``column`` has no ``key`` in ``parent``."""
    keys = parent.select(F.col(key).alias("__parent")).where("__parent IS NOT NULL").distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__parent"), "left_anti")


def integrity(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows without a reference, and rows whose reference leads nowhere."""
    known = parent.select(F.col(key).alias("__parent")).where("__parent IS NOT NULL").distinct()
    # references are counted before the join, so that a hot one is a single row
    counts = child.groupBy(F.col(column).alias("__ref")).agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(known, F.col("__ref") == F.col("__parent"), "left")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return met.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        total(F.col("__ref").isNull()).alias("missing"),
        total(F.col("__ref").isNotNull() & F.col("__parent").isNull()).alias("orphans"),
    )


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson's coefficient of every pair of columns over the rows that have both, in one pass."""
    pairs = list(combinations(columns, 2))
    number = lambda c: F.col(c).cast("double")
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(
        *[F.count_if(both(a, b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
        *[F.corr(number(a), number(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
    )
    entries = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"n{i}").alias("n"), F.round(F.col(f"r{i}"), digits).alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*entries)))


def split(df: DataFrame, key: str, shares: dict[str, float], seed: int | str = 42, into: str = "part") -> DataFrame:
    """Deal rows to named parts by their draw; ``shares`` are taken in order and scaled to 1."""
    total, upto, rules = sum(shares.values()), 0.0, []
    for name, share in shares.items():
        upto += share / total
        rules.append((name, upto))
    drawn = uniform(key, seed)
    picked = F.lit(rules[-1][0])
    for name, limit in reversed(rules[:-1]):
        picked = F.when(drawn < limit, F.lit(name)).otherwise(picked)
    return df.withColumn(into, picked)


def where_all(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet every condition (column, one of = != < <= > >= in, value); a null meets none."""
    tests = {
        "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)),
    }
    met = [tests[op](F.col(column), value) for column, op, value in conditions]
    return df.where(reduce(Column.__and__, met, F.lit(True)))


def changes(before: DataFrame, after: DataFrame, key: str, method: str, at: str) -> DataFrame:
    """A change log: one row per cell that differs between two versions, old and new value as text.

    The cells of an added row have no old value, those of a deleted row no new one.
    """
    columns = [c for c in before.columns if c != key and c in after.columns]
    pair = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full")
    entries = [
        F.when(
            ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")),
            F.struct(F.lit(c).alias("column"), F.col(f"b.{c}").cast("string").alias("old"), F.col(f"a.{c}").cast("string").alias("new")),
        )
        for c in columns
    ]
    found = pair.select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), F.inline(F.array_compact(F.array(*entries))))
    return found.withColumns({"method": F.lit(method), "changed_at": F.lit(at).cast("timestamp")})


def kappa(df: DataFrame, first: str, second: str, digits: int = 6) -> DataFrame:
    """Cohen's kappa of two annotators over the rows that both have labelled."""
    counts = confusion(df.where(F.col(first).isNotNull() & F.col(second).isNotNull()), first, second)
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)).alias("same"))
    one = counts.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("a"))
    two = counts.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("b"))
    chance = one.join(two, "c").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("double").alias("chance"))  # one row per class
    n, observed = F.col("n").cast("double"), F.col("same") / F.col("n")
    expected = chance.scalar() / (n * n)
    return total.select("n", F.round(observed, digits).alias("agreement"), F.round(F.when(expected < 1, (observed - expected) / (1 - expected)), digits).alias("kappa"))


def forward_fill(df: DataFrame, group: str, time: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the last value before them in the same group; ``time`` must order a group's rows.

    Rows are sorted by range over all groups, so a group that holds most of the
    table is spread over many tasks. Each partition passes on the last values of
    the group it ends with; that is one row per partition.
    """
    slot = F.monotonically_increasing_id()
    rows = materialize(df.orderBy(group, *time).withColumn("__slot", slot)).withColumn("__part", F.shiftright("__slot", 33))
    inside = Window.partitionBy("__part", group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({f"__f{i}": F.last(c, ignorenulls=True).over(inside) for i, c in enumerate(columns)})
    values = F.struct(*[F.col(f"__f{i}") for i in range(len(columns))])
    edges = filled.groupBy("__part").agg(
        F.min_by(F.struct(F.col(group).alias("g")), "__slot").alias("first"), F.max_by(F.struct(F.col(group).alias("g"), values.alias("v")), "__slot").alias("last")
    )
    passed = edges.select(F.col("last.g").alias("__g"), "__part", F.lit(1).alias("__gives"), *[F.col(f"last.v.__f{i}").alias(f"__c{i}") for i in range(len(columns))])
    asked = edges.select(F.col("first.g").alias("__g"), "__part", F.lit(0).alias("__gives"), *[F.lit(None).cast(df.schema[c].dataType).alias(f"__c{i}") for i, c in enumerate(columns)])
    upto = Window.partitionBy("__g").orderBy("__part", "__gives").rowsBetween(Window.unboundedPreceding, -1)
    carried = passed.unionByName(asked).withColumns({f"__c{i}": F.last(f"__c{i}", ignorenulls=True).over(upto) for i in range(len(columns))}).where("__gives = 0")
    carried = carried.select("__g", F.col("__part").alias("__p"), *[f"__c{i}" for i in range(len(columns))])
    met = filled.join(F.broadcast(carried), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")  # one row per partition
    return met.select(*[F.coalesce(f"__f{columns.index(c)}", f"__c{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns])


def drift(reference: DataFrame, current: DataFrame, column: str, edges: Sequence[float], digits: int = 6) -> DataFrame:
    """Population stability index over the bins between ``edges``: one row per bin and the index of all."""
    bins = F.lit(0)
    for edge in edges:
        bins = bins + (F.col(column) >= edge).cast("int")

    def shares(df: DataFrame, name: str) -> DataFrame:
        counted = df.where(F.col(column).isNotNull()).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))  # one row per bin

    joined = shares(reference, "expected").join(shares(current, "actual"), "bin", "full")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in ("expected", "actual"))
    scored = joined.select("bin", e.alias("expected"), a.alias("actual"), ((a - e) * F.log(a / e)).alias("part"))
    whole = F.sum("part").over(Window.partitionBy(F.lit(0)))
    return scored.select("bin", *[F.round(c, digits).alias(c) for c in ("expected", "actual", "part")], F.round(whole, digits).alias("psi"))
