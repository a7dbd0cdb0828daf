"""Reproducible random draws.

A draw depends only on a row's key and a seed, so a sample is the same for any
partitioning, any retry and any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 4294967296  # draws are 32-bit


def draw(key: Column | str, seed: int | str | Column) -> Column:
    """A 32-bit integer draw for ``key`` under ``seed``."""
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def wide_draw(key: Column | str, seed: int | str | Column) -> Column:
    """A 60-bit draw, for picking among more rows than 32 bits can number."""
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(key: Column | str, seed: int | str | Column) -> Column:
    """The same draw as a double in [0, 1)."""
    return draw(key, seed) / F.lit(float(DRAW_RANGE))
