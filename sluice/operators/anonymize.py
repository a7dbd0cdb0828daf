"""Take personal data out of tables. Nulls stay null for every method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.lookups import attach
from sluice.functions.ranks import ordered_index
from sluice.functions.text import before_last, plain_text, stars
from sluice.functions.types import is_numeric, is_string

# Fixed values
REDACTED = "[REDACTED]"
OTHER = "Other"
DASH = "–"
BUCKET = 10
TOP_N = 5


def mask(text: Column) -> Column:
    """Keep the first character (and the last, or a mail address's shape)."""
    length = F.length(text)
    local, domain = before_last(text, "@"), F.substring_index(text, "@", -1)
    dotted = F.contains(domain, F.lit("."))
    host = F.when(dotted, before_last(domain, ".")).otherwise(domain)
    suffix = F.when(dotted, F.concat(F.lit("."), F.substring_index(domain, ".", -1))).otherwise(F.lit(""))
    more = lambda part: stars(F.greatest(F.length(part) - 1, F.lit(1)))
    mail = F.concat(
        F.substring(text, 1, 1), more(local), F.lit("@"), F.substring(host, 1, 1), more(host), suffix
    )
    plain = F.concat(F.substring(text, 1, 1), stars(length - 2), F.substring(text, -1, 1))
    return F.when(F.contains(text, F.lit("@")), mail).when(length <= 2, stars(length)).otherwise(plain)


def redact(column: Column) -> Column:
    return F.when(column.isNotNull(), F.lit(REDACTED))


def hashed(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def bucketed(number: Column, size: int = BUCKET) -> Column:
    low = F.floor(number / F.lit(float(size))).cast("bigint") * size
    return F.concat(low.cast("string"), F.lit(DASH), (low + (size - 1)).cast("string"))


def reads_as_number(df: DataFrame, name: str) -> bool:
    """Whether every non-null value of the column is a number; one aggregate for text."""
    if is_numeric(df.schema[name].dataType):
        return True
    if not is_string(df.schema[name].dataType):
        return False
    column = F.col(name)
    bad = df.agg(F.count_if(column.isNotNull() & column.try_cast("double").isNull()).alias("n")).first()
    return bad["n"] == 0


def keep_top(df: DataFrame, name: str, top_n: int = TOP_N) -> Column:
    """The most frequent values as they are, all others as one; ties go by value."""
    text = plain_text(df, name)
    counts = df.select(text.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "v").limit(top_n)
    kept = top.agg(F.collect_list("v").alias("kept")).scalar()  # top_n values
    return F.when(text.isNotNull(), F.when(F.array_contains(kept, text), text).otherwise(F.lit(OTHER)))


def pseudonymize(df: DataFrame, name: str, key: str) -> DataFrame:
    """Replace each value by a number in the order of first appearance by ``key``."""
    named = df.withColumn("__text", plain_text(df, name))
    values = (
        named.where(F.col("__text").isNotNull())
        .groupBy(F.col("__text").alias("key"))
        .agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    )
    numbered = ordered_index(values, ["first", "key"], "number", start=1)
    table = numbered.select("key", "n", F.concat(F.lit("ID-"), _padded(F.col("number"))).alias("alias"))
    out = attach(named, "__text", table, "alias", "__alias")
    return out.select(*[F.col("__alias").alias(c) if c == name else F.col(c) for c in df.columns])


def _padded(number: Column, width: int = 5) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def anonymize(df: DataFrame, configs: Sequence[dict], key: str | None = None) -> DataFrame:
    """Apply one method per named column; columns not named are kept.

    All methods but pseudonyms become one projection. Pseudonyms need the row
    ``key`` that says which value appears first.
    """
    by_column = {c["column"]: c for c in configs if c["column"] in df.columns}
    out = df
    for name, config in by_column.items():
        if config.get("method") == "pseudonymize":
            if key is None:
                raise ValueError("pseudonymize needs the key that orders the rows")
            out = pseudonymize(out, name, key)
    picks = []
    for name in df.columns:
        config = by_column.get(name, {})
        method, params = config.get("method", "keep"), config.get("params", {})
        if method == "suppress":
            continue
        picks.append(_transformed(df, name, method, params).alias(name))
    return out.select(*picks)


def _transformed(df: DataFrame, name: str, method: str, params: dict) -> Column:
    column = F.col(name)
    if method == "redact":
        return redact(column)
    if method == "mask":
        return mask(plain_text(df, name))
    if method == "hash":
        return hashed(plain_text(df, name))
    if method == "generalize":
        if reads_as_number(df, name):
            return bucketed(column.cast("double"), int(params.get("bucket_size", BUCKET)))
        return keep_top(df, name, int(params.get("top_n", TOP_N)))
    return column  # keep, pseudonyms (already in place) and unknown methods


METHODS = ("redact", "mask", "hash", "generalize", "pseudonymize", "suppress")


def job_summary(df: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """One row: rows, columns transformed and columns left after a job."""
    used = [c for c in configs if c["column"] in df.columns and c.get("method") in METHODS]
    dropped = sum(c["method"] == "suppress" for c in used)
    return df.agg(F.count(F.lit(1)).alias("rows_processed")).select(
        "rows_processed", F.lit(len(used)).alias("columns_transformed"),
        F.lit(len(df.columns) - dropped).alias("columns_out"),
    )
