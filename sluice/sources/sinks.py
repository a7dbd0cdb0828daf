"""Write results; never over the files they were read from."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.files import CSV, suffix_of


def save_output(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write as parquet, JSON lines or (any other name) CSV with a header."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt in ("json", "jsonl"):
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        # blanks at the ends of a text are kept, and an empty text is told from a missing one
        plain = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""'}
        df.write.mode("overwrite").options(**CSV, **plain).csv(path)
    return path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions below ``root``, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = []
    for entry in fs.listStatus(base):
        match = re.fullmatch(r"v(\d+)\.\w+", entry.getPath().getName())
        if match and fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(match.group(1)))
    return sorted(found)


def save_version(df: DataFrame, root: str, name: str) -> str:
    """Write the next version of a dataset in the format its name asks for.

    A fix reads version n and writes version n+1, so the input stays readable
    for retries and for going back.
    """
    suffix = suffix_of(name)
    fmt = suffix.lstrip(".") if suffix in (".parquet", ".json", ".jsonl") else "csv"
    done = versions(df.sparkSession, root)
    number = done[-1] + 1 if done else 1
    return save_output(df, f"{root}/v{number}.{fmt}", fmt)


def latest_version(spark: SparkSession, root: str, name: str) -> str:
    suffix = suffix_of(name)
    fmt = suffix.lstrip(".") if suffix in (".parquet", ".json", ".jsonl") else "csv"
    done = versions(spark, root)
    if not done:
        raise FileNotFoundError(root)
    return f"{root}/v{done[-1]}.{fmt}"
