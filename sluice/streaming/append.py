"""The audit log and row-wise chains fed by a stream.

Both are stateless, so the stream needs no watermark, and what they write is
what the batch forms write over the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sluice.operators import audit, steps

ROW_WISE = ("filter", "select_columns", "drop_columns", "rename_column", "lowercase")


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the audit log; takes what is there, then stops.

    Files are committed once per micro-batch, so a restart neither loses nor
    repeats events.
    """
    return (
        audit.categorized(events)
        .writeStream.format("parquet")
        .partitionBy("category")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_steps(stream: DataFrame, chain: Sequence[dict]) -> DataFrame:
    """Apply a chain of steps that look at one row at a time, or drop rows with a null."""
    for step in chain:
        kind, config = step.get("type"), step.get("config", {})
        drops = kind == "fill_nulls" and config.get("strategy", "drop_rows") in ("drop_rows", "value")
        if kind in steps.STEPS and kind not in ROW_WISE and not drops:
            raise ValueError(f"step {kind} needs the whole table")
    return steps.run_steps(stream, chain)
