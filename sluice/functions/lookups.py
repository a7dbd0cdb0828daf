"""Attach a value per key to a large table whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.types import groupable_columns

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
HOT_SHARE = 200  # a key with at least 1/200 of all rows is hot, so at most 200 are
SALTS = 1024


def attach(df: DataFrame, column: str, table: DataFrame, payload: str, into: str) -> DataFrame:
    """Left join ``table(key, n, payload)`` on ``column = key`` as column ``into``.

    ``table`` holds each key once with its row count ``n`` and must be cheap to
    read twice (materialised). It is broadcast when its measured size allows.
    Otherwise only the hot keys are broadcast, of which there are at most 200,
    and the others are joined by shuffle; rows already served are spread over
    salts so that they cannot pile up in one task.
    """
    size = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.col("key").cast("string")) + 16), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    ).first()
    keep = [c for c in df.columns if c != into]
    small = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    served = table if small else table.where(F.col("n") * HOT_SHARE >= F.lit(size["total"]))
    served = served.select(F.col("key").alias("__key"), F.col(payload).alias("__hit"))
    hit = df.join(F.broadcast(served), F.col(column) == F.col("__key"), "left")
    if small:
        return hit.select(*keep, F.col("__hit").alias(into))
    rest = table.where(F.col("n") * HOT_SHARE < F.lit(size["total"])).select(
        F.col("key").alias("__cold"), F.lit(0).alias("__zero"), F.col(payload).alias("__cold_hit")
    )
    salt = F.pmod(F.xxhash64(*groupable_columns(df)), F.lit(SALTS)).cast("int")
    open_key = F.when(F.col("__key").isNull(), F.col(column))
    return (
        hit.withColumn("__open", open_key)
        .withColumn("__salt", F.when(F.col("__open").isNull(), salt).otherwise(F.lit(0)))
        .join(rest, (F.col("__open") == F.col("__cold")) & (F.col("__salt") == F.col("__zero")), "left")
        .select(*keep, F.coalesce("__hit", "__cold_hit").alias(into))
    )
