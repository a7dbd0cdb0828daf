"""Read tabular files into DataFrames and describe them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.types import dtype_label

# Suffixes that may be read.
READABLE = (".csv", ".json", ".jsonl", ".parquet")
CSV = {"quote": '"', "escape": '"'}  # a quote inside a cell is doubled
EMPTY = "\ue000"  # stands for a quoted empty cell while a file is read, to tell it from a missing one


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by suffix; the path may be a file or a folder on any Hadoop file system."""
    suffix = suffix_of(path)
    if suffix == ".csv":
        return read_csv(spark, path, schema)
    if suffix in (".json", ".jsonl"):
        return read_json(spark, path, schema)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: {suffix or path}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, rejects: str | None = None) -> DataFrame:
    """CSV with a header; quoted cells may hold separators, line breaks and doubled quotes.

    Without a schema the types are inferred from all cells by the same reader.
    Nothing is lost silently: with ``rejects`` a column of that name holds the
    whole line of every row that has a cell which does not fit its type; such
    cells are null. ``""`` is an empty text, nothing between separators a null.
    Cells may span lines, so one file is one split: write CSV in many files.
    """
    reader = spark.read.options(**CSV, header=True, multiLine=True, emptyValue=EMPTY, mode="PERMISSIVE")
    if schema is None:
        schema = reader.option("inferSchema", True).csv(path).schema
    if rejects:
        schema = T.StructType([*schema.fields, T.StructField(rejects, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", rejects)
    out = reader.schema(schema).csv(path)
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType) and f.name != rejects]
    return out.withColumns({c: F.when(F.col(f"`{c}`") == EMPTY, F.lit("")).otherwise(F.col(f"`{c}`")) for c in texts})


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per line, or a file holding one array of objects."""
    opening = (
        spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    )
    reader = spark.read.schema(schema) if schema else spark.read
    if opening is not None and opening["c"] == "[":
        reader = reader.option("multiLine", True)
    return reader.json(path)


def invalid_utf8(spark: SparkSession, path: str) -> DataFrame:
    """Per file: its lines and how many of them are not valid UTF-8."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file_name"), F.is_valid_utf8("value").alias("ok")
    )
    return lines.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("invalid_lines")
    )


def infer_schema(df: DataFrame) -> DataFrame:
    """Name, dtype label and whether the column really holds nulls, one row per column."""
    counts = df.agg(
        *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in enumerate(df.schema)]
    )
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("name"),
            F.lit(dtype_label(f.dataType)).alias("dtype"),
            (F.col(f"n{i}") > 0).alias("nullable"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*entries)))


def head(df: DataFrame, rows: int, key: Sequence[str | Column] | None = None) -> DataFrame:
    """The first rows; with ``key`` the rows that sort first, whatever the partitioning."""
    return (df.orderBy(*key) if key else df).limit(rows)


def preview(df: DataFrame, key: Sequence[str | Column] | None = None, rows: int = 3) -> DataFrame:
    """Sample rows as JSON next to the column and row counts of the dataset."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return head(df, rows, key).select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("sample_row"),
        total.alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
    )


def ingest_summary(df: DataFrame) -> DataFrame:
    """Row count, column count and bytes of the files behind a file-based DataFrame."""
    per_file = df.groupBy(F.col("_metadata.file_path").alias("p")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    return per_file.agg(
        F.sum("rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.sum("bytes").alias("size_bytes"),
    )
