"""Text forms of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.types import FLOATS, is_string


def plain_text(df: DataFrame, name: str) -> Column:
    """A column as text, without loss: doubles with all their digits, written out from 0.0001 to below 1e16."""
    column, data_type = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(data_type, FLOATS):
        return written_out(column)
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, FLOATS):
        return F.transform(column, written_out).cast("string")
    return column if is_string(data_type) else column.cast("string")


def written_out(number: Column) -> Column:
    """A floating-point number without an exponent; very small and very large ones as ``1e-05`` and ``1e+16``."""
    text = number.cast("string")
    power = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"[-.]|\.0$", "")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    part = F.substring(digits, power + 2, F.lit(64))
    large = F.concat(sign, whole, F.lit("."), F.when(F.length(part) > 0, part).otherwise(F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power_text = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    size = F.abs(number)
    return (
        F.when(~text.contains("E"), text)
        .when(size.between(1e7, 9999999999999998.0), large)
        .when((size >= 1e-4) & (size < 1), small)
        .otherwise(F.concat(mantissa, power_text))
    )


def stars(count: Column) -> Column:
    return F.repeat(F.lit("*"), count.cast("int"))


def before_last(text: Column, mark: str) -> Column:
    """What stands before the last ``mark``."""
    tail = F.length(F.substring_index(text, mark, -1))
    return F.substring(text, F.lit(1), (F.length(text) - tail - 1).cast("int"))
