"""Facts about every column of a table, found in a fixed number of passes.

The number of Spark jobs does not depend on the number of columns: one wide
aggregate for counts, moments and sketches of the quartiles, two that read the
quartiles off what the sketches leave open, one for values beyond the fences, one grouping of all text values and one of
whole rows. What comes back is as wide as the schema, never as long as the data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.quantiles import from_sketches, quantiles, sketches
from sluice.functions.types import dtype_label, comparable, is_numeric, is_string, kind_of
from sluice.session import small_frame

# Fixed values
LABEL_NAMES = ("label", "target", "y", "class", "category", "output", "outcome")
FENCE = 3.0
MIN_VALUES_FOR_FENCE = 10
TOP_VALUES = 10
MOST_COLUMNS_PER_AGGREGATE = 200

PARTS = ("nulls", "case", "moments", "outliers", "values")

FACTS = """ordinal int, column string, kind string, dtype string, is_label boolean, rows bigint, nulls bigint,
    lower_n bigint, upper_n bigint, min double, max double, mean double, std double, skew double,
    numbers bigint, q1 double, median double, q3 double, outliers bigint,
    distinct_n bigint, top_n bigint, bottom_n bigint, top_value string,
    top array<struct<label: string, count: bigint>>"""


def label_columns(df: DataFrame) -> list[str]:
    """Columns with a label's name; failing that, a last column of text or booleans."""
    named = [c for c in df.columns if c.lower() in LABEL_NAMES]
    if named:
        return named
    last = df.schema[-1]
    return [last.name] if dtype_label(last.dataType) in ("string", "boolean") else []


def _wide(df: DataFrame, parts: Iterable[str], sketched: Iterable[str] = ()) -> tuple[dict[str, dict], dict]:
    """Counts and moments of all columns, and quartile sketches of some, by one aggregate per block of columns."""
    found: dict[str, dict] = {}
    bracketed: dict = {}
    fields = list(df.schema)
    for at in range(0, len(fields), MOST_COLUMNS_PER_AGGREGATE):
        block = fields[at : at + MOST_COLUMNS_PER_AGGREGATE]
        wanted: list[Column] = [F.count(F.lit(1)).alias("rows")]
        for i, field in enumerate(block):
            c = F.col(f"`{field.name}`")
            wanted.append(F.count(c).alias(f"{i}:present"))
            if "case" in parts and "values" not in parts and is_string(field.dataType):
                wanted.append(F.count_if(F.lower(c) == c).alias(f"{i}:lower_n"))
                wanted.append(F.count_if(F.upper(c) == c).alias(f"{i}:upper_n"))
            if "moments" in parts and is_numeric(field.dataType):
                x = c.cast("double")
                wanted += [
                    F.min(x).alias(f"{i}:min"),
                    F.max(x).alias(f"{i}:max"),
                    F.avg(x).alias(f"{i}:mean"),
                    F.stddev_pop(x).alias(f"{i}:std"),
                    F.skewness(x).alias(f"{i}:skew"),
                ]
        wanted += sketches([f.name for f in block if f.name in sketched], QUARTILES)
        row = df.agg(*wanted).first().asDict()
        bracketed |= {k: v for k, v in row.items() if k.startswith("sketch:")}
        for i, field in enumerate(block):
            own = {k.split(":", 1)[1]: v for k, v in row.items() if k.startswith(f"{i}:")}
            present = own.pop("present")
            found[field.name] = {"rows": row["rows"], "nulls": row["rows"] - present, **own}
            if is_numeric(field.dataType):
                found[field.name]["numbers"] = present
    return found, bracketed


QUARTILES = (0.25, 0.5, 0.75)


def quartiles(df: DataFrame, approximate: bool = False) -> DataFrame:
    names = [f.name for f in df.schema if is_numeric(f.dataType)]
    return quantiles(df, names, QUARTILES, approximate=approximate)


def fences(q1: float | None, q3: float | None, n: int) -> tuple[float, float] | None:
    """Bounds beyond which a value is an outlier; None where they are not defined."""
    if q1 is None or q3 is None or n < MIN_VALUES_FOR_FENCE or q3 == q1:
        return None
    return q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)


def _beyond_fences(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    if not bounds:
        return {}
    names = list(bounds)
    outside = [
        F.count_if((F.col(f"`{c}`") < bounds[c][0]) | (F.col(f"`{c}`") > bounds[c][1])).alias(str(i))
        for i, c in enumerate(names)
    ]
    row = df.agg(*outside).first()
    return {c: row[str(i)] for i, c in enumerate(names)}


def value_counts(df: DataFrame) -> DataFrame:
    """``column, value, n`` for the non-null values of all text columns in one shuffle."""
    names = [f.name for f in df.schema if is_string(f.dataType)]
    if not names:
        return small_frame(df.sparkSession, [], "column string, value string, n bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names])
    long = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per column; Spark trims to k before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def value_facts(counts: DataFrame, with_top: bool = True) -> DataFrame:
    """Distinct values, largest and smallest class and the most frequent value per column.

    Case is a property of a value, so it is looked at once per distinct value.
    """
    value = F.col("value")
    facts = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_n"),
        F.sum(F.when(F.lower(value) == value, F.col("n")).otherwise(0)).alias("lower_n"),
        F.sum(F.when(F.upper(value) == value, F.col("n")).otherwise(0)).alias("upper_n"),
        F.max("n").alias("top_n"),
        F.min("n").alias("bottom_n"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))["value"].alias("top_value"),
    )
    if not with_top:
        return facts
    top = (
        top_values(counts)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("t"))
        .select("column", F.transform("t", lambda s: F.struct(s["value"].alias("label"), s["n"].alias("count"))).alias("top"))
    )
    return facts.join(top, "column")


def duplicates(df: DataFrame) -> DataFrame:
    """One row: all rows, and those that repeat an earlier one."""
    names, entries = comparable(df)
    copies = df.withColumns(entries).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies")
    )


def facts(df: DataFrame, parts: Iterable[str] = PARTS, approximate: bool = False) -> DataFrame:
    """One row per column with what ``parts`` ask for, the rest null.

    ``approximate`` takes quartiles from a sketch instead of exact ones.
    """
    parts = set(parts)
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    ranked = numeric if parts & {"outliers", "moments"} else []
    found, bracketed = _wide(df, parts, () if approximate else ranked)
    labels = label_columns(df)
    if ranked:
        bounds = {}
        read = {r["column"]: (r["n"], r["q"]) for r in quartiles(df, approximate=True).collect()} if approximate else from_sketches(df, ranked, QUARTILES, bracketed)
        for c, (n, q) in read.items():
            q1, median, q3 = q or (None, None, None)
            found[c].update(q1=q1, median=median, q3=q3)
            limits = fences(q1, q3, n)
            if limits:
                bounds[c] = limits
        if "outliers" in parts:
            for c in numeric:
                found[c]["outliers"] = 0
            for c, n in _beyond_fences(df, bounds).items():
                found[c]["outliers"] = n
    if "values" in parts:
        for c in (f.name for f in df.schema if is_string(f.dataType)):
            found[c].update(lower_n=0, upper_n=0)
        for r in value_facts(value_counts(df)).collect():  # one row per text column
            found[r["column"]].update(
                distinct_n=r["distinct_n"], lower_n=r["lower_n"], upper_n=r["upper_n"], top_n=r["top_n"], bottom_n=r["bottom_n"], top_value=r["top_value"],
                top=[t.asDict() for t in r["top"]],
            )
    names = [part.split()[0] for part in FACTS.replace("\n", " ").split(", ") if ":" not in part] + ["top"]
    out = []
    for i, field in enumerate(df.schema):
        known = {
            "ordinal": i, "column": field.name, "kind": kind_of(field.dataType),
            "dtype": dtype_label(field.dataType), "is_label": field.name in labels, **found[field.name],
        }
        out.append(tuple(known.get(n) for n in names))
    return small_frame(df.sparkSession, out, FACTS)
