"""The registered queries: what runs on the given tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

AREAS = (
    "files",
    "steps",
    "quality",
    "cleaning",
    "privacy",
    "governance",
    "graph",
    "synthetic",
    "learning",
    "relations",
    "streams",
    "trust",
)


def all_queries() -> dict[str, Query]:
    return _gather("QUERIES")


def all_sql() -> dict[str, str]:
    return _gather("SQL")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"sluice.plans.{area}"), attribute)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found
