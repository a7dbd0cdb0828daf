"""The audit log: append, search, count and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.times import as_time, moment

# What the part of an event type before the first dot stands for.
CATEGORIES = {
    "dataset": "data",
    "pipeline": "pipeline",
    "pipeline_run": "pipeline",
    "al": "ml",
    "benchmark": "ml",
    "synthetic": "ml",
    "compliance": "compliance",
    "marketplace": "marketplace",
    "settings": "settings",
}
# The header of an export.
EXPORT_COLUMNS = (
    "id", "event_type", "category", "entity_type", "entity_id", "entity_name", "duration_ms", "created_at", "metadata",
)


def category(event_type: Column) -> Column:
    prefix = F.substring_index(event_type, ".", 1)
    pairs = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return F.coalesce(pairs[prefix], F.lit("data"))


def categorized(events: DataFrame) -> DataFrame:
    return events.withColumn("category", category(F.col("event_type")))


def append(events: DataFrame, path: str) -> None:
    """Add events to the log, one folder per category so that searches read little."""
    categorized(events).write.mode("append").partitionBy("category").parquet(path)


def search(
    log: DataFrame, category: str | None = None, event_type: str | None = None, entity_name: str | None = None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Newest first; the page is cut by a top-k, not by a full sort."""
    found = log
    if category:
        found = found.where(F.col("category") == category)
    if event_type:
        found = found.where(F.col("event_type") == event_type)
    if entity_name:
        found = found.where(F.col("entity_name").ilike(f"%{entity_name}%"))
    return found.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def count_since(log: DataFrame, since: str | None = None) -> DataFrame:
    kept = log.where(as_time("created_at") >= moment(since)) if since else log
    return kept.agg(F.count(F.lit(1)).alias("n"))


def excerpt(log: DataFrame, limit: int = 50) -> DataFrame:
    return search(log, category="compliance", limit=limit).select("event_type", "entity_name", "created_at", "metadata")


def export(log: DataFrame, rows: int | None = None) -> DataFrame:
    """All events, or the newest ``rows``, with the metadata as JSON text, for a CSV sink."""
    newest = search(log, limit=rows) if rows is not None else log
    kind = newest.schema["metadata"].dataType.typeName()
    text = F.col("metadata") if kind == "string" else F.to_json("metadata")
    return newest.withColumn("metadata", text).select(*[c for c in EXPORT_COLUMNS if c in newest.columns])
