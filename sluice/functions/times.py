"""Times and ages. The moment of evaluation is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000.0


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def as_time(column: Column | str) -> Column:
    """ISO text or a time column as a timestamp; text that is no time becomes null."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("timestamp")


def age_days(column: Column | str, as_of: str) -> Column:
    """Days between a time and ``as_of``; 0 where the time cannot be read."""
    passed = F.unix_micros(moment(as_of)) - F.unix_micros(as_time(column))
    return F.coalesce(passed / F.lit(DAY_MICROS), F.lit(0.0))
