"""Take in files of text as they arrive: rows that fit the schema go to one table, the others to quarantine with their reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.session import checkpoint_dir

CORRUPT = "__corrupt"


@dataclass(frozen=True)
class Field:
    """A column as it should arrive: its type, whether it must be there, and bounds or a list that its values keep to."""

    name: str
    dtype: str
    required: bool = False
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] = ()

    def typed(self) -> Column:
        """The value in its type; null where the text does not say one. Blank text is no value."""
        text = F.nullif(F.trim(F.col(f"`{self.name}`")), F.lit(""))
        return text.try_cast(self.dtype)

    def faults(self, typed: str) -> list[tuple[Column, str]]:
        """What may be wrong with the column ``typed`` that :meth:`typed` made, and its name."""
        absent = F.coalesce(F.trim(F.col(f"`{self.name}`")), F.lit("")) == ""
        value = F.col(typed)
        out = [(~absent & value.isNull(), f"{self.name}: not {self.dtype}")]
        if self.required:
            out.append((absent, f"{self.name}: missing"))
        if self.least is not None:
            out.append((value < self.least, f"{self.name}: below {self.least}"))
        if self.most is not None:
            out.append((value > self.most, f"{self.name}: above {self.most}"))
        if self.allowed:
            out.append((~value.isin(*self.allowed), f"{self.name}: not allowed"))
        return out


def arrivals(spark: SparkSession, folder: str, fields: Sequence[Field], file_format: str = "csv", files_per_batch: int = 8) -> DataFrame:
    """The files of ``folder`` as a stream of text columns, and the whole line where it could not be split into them."""
    schema = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.format(file_format).schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
    if file_format == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "true").option("nullValue", "").option("escape", '"')
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def checked(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``rows`` with their typed values in ``__typed`` and a list of what is wrong in ``__reasons``; one projection, no shuffle."""
    names = {f.name: f"__t{i}" for i, f in enumerate(fields)}
    typed = rows.withColumns({names[f.name]: f.typed() for f in fields})
    found = [F.when(test, F.lit(text)) for f in fields for test, text in f.faults(names[f.name])]
    broken = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("line: broken")))
    reasons = F.coalesce(broken, F.array_compact(F.array(*found)))
    return typed.select(
        *[f"`{f.name}`" for f in fields], CORRUPT, F.struct(*[F.col(names[f.name]).alias(f.name) for f in fields]).alias("__typed"), reasons.alias("__reasons")
    )


def write_batch(rows: DataFrame, batch: int, fields: Sequence[Field], good: str, quarantine: str) -> None:
    """Split one batch over the two tables.

    Each batch owns a folder in either table and replaces what is there, so a
    batch that is run again after a failure adds nothing.
    """
    seen = checked(rows, fields).persist()  # both writes read it; a lost executor only means computing it again
    try:
        kept = seen.where(F.size("__reasons") == 0).select("__typed.*")
        kept.write.mode("overwrite").parquet(f"{good}/batch_id={batch}")
        bad = seen.where(F.size("__reasons") > 0)
        raw = F.to_json(F.struct(*[f"`{f.name}`" for f in fields]), {"ignoreNullFields": "false"})
        bad.select(F.coalesce(CORRUPT, raw).alias("raw"), F.concat_ws("; ", "__reasons").alias("reasons")).write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch}")
    finally:
        seen.unpersist()


def ingest(stream: DataFrame, fields: Sequence[Field], good: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Take in all files that have come since the last run, in batches, then stop.

    The checkpoint remembers which files were taken, so a restart goes on where
    the last run ended. Tables are written to ``good`` and ``quarantine``.
    """
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, fields, good, quarantine))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def taken(spark: SparkSession, fields: Sequence[Field], good: str, quarantine: str) -> tuple[DataFrame, DataFrame]:
    """The two tables as they stand, with the batch each row came in."""
    typed = T.StructType([*[T.StructField(f.name, T._parse_datatype_string(f.dtype)) for f in fields], T.StructField("batch_id", T.LongType())])
    bad = T.StructType.fromDDL("raw string, reasons string, batch_id bigint")
    return spark.read.schema(typed).parquet(good), spark.read.schema(bad).parquet(quarantine)


def scratch(spark: SparkSession, label: str) -> str:
    """A folder for a stream's checkpoint, in the cluster's shared folder."""
    return f"{checkpoint_dir(spark)}/{label}"
