"""Which columns count as numeric, text or groupable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)

# The dtype labels shown to users.
LABELS = (
    (INTEGERS, "integer"),
    (FLOATS, "float"),
    ((T.BooleanType,), "boolean"),
    ((T.StringType,), "string"),
    ((T.DateType,), "date"),
    ((T.TimestampType, T.TimestampNTZType), "datetime"),
    ((T.ArrayType,), "list"),
    ((T.StructType,), "struct"),
)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGERS + FLOATS)


def is_string(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def dtype_label(data_type: T.DataType) -> str:
    for kinds, label in LABELS:
        if isinstance(data_type, kinds):
            return label
    return data_type.simpleString()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_string(f.dataType)]


def groupable_columns(df: DataFrame) -> list[str]:
    """Every column but maps, which Spark can neither hash nor group by."""
    return [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]


def comparable(df: DataFrame) -> tuple[list[str], dict[str, Column]]:
    """The columns by which rows can be grouped, and for every map a column of its sorted entries."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    entries = {f"__entries_{i}": F.array_sort(F.map_entries(f"`{c}`")) for i, c in enumerate(maps)}
    return [*groupable_columns(df), *entries], entries


def kind_of(data_type: T.DataType) -> str:
    if is_numeric(data_type):
        return "numeric"
    return "string" if is_string(data_type) else "other"
