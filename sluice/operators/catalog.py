"""Search and ranking over catalog assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scalars import beside

TYPES = ("dataset", "pipeline", "model", "benchmark")


def matches(query: str) -> Column:
    """Case-insensitive substring of the title, the description or any tag."""
    needle = F.lit(query.lower())
    within = lambda c: F.contains(F.lower(c), needle)
    hit = within(F.col("title")) | within(F.col("description")) | F.exists("tags", within)
    return F.coalesce(hit, F.lit(False))


def search(assets: DataFrame, query: str | None = None, kind: str | None = None, category: str | None = None) -> DataFrame:
    found = assets.where(F.col("status") == "published")
    if kind:
        found = found.where(F.col("asset_type") == kind)
    if category:
        found = found.where(F.col("category") == category)
    return found.where(matches(query)) if query else found


ORDERS = {
    "newest": ("published_at",),
    "rating": ("rating_avg", "rating_count"),
    "trending": ("view_count",),
    "popular": ("download_count",),
}


def page(assets: DataFrame, sort: str = "popular", number: int = 1, limit: int = 24) -> DataFrame:
    """One page in the chosen order; ties go by id."""
    order = [F.col(c).desc() for c in ORDERS.get(sort, ORDERS["popular"])]
    return assets.orderBy(*order, "id").offset((number - 1) * limit).limit(limit)


def featured(assets: DataFrame, per_type: int = 3, total: int = 8) -> DataFrame:
    """The most downloaded per type, and the most downloaded of those."""
    best = Window.partitionBy("asset_type").orderBy(F.col("download_count").desc(), "id")
    published = assets.where(F.col("status") == "published")
    top = published.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_type)
    return top.orderBy(F.col("download_count").desc(), "id").limit(total).drop("place")


def with_ratings(assets: DataFrame, reviews: DataFrame) -> DataFrame:
    """Average (two decimals) and number of ratings, zero without reviews."""
    rated = reviews.groupBy("asset_id").agg(
        F.round(F.avg("rating"), 2).alias("__avg"), F.count(F.lit(1)).alias("__n")
    )
    joined = assets.drop("rating_avg", "rating_count").join(rated, F.col("id") == F.col("asset_id"), "left")
    return joined.select(
        *[c for c in assets.columns if c not in ("rating_avg", "rating_count")],
        F.coalesce("__avg", F.lit(0.0)).alias("rating_avg"),
        F.coalesce("__n", F.lit(0)).alias("rating_count"),
    )


def stats(assets: DataFrame, installs: DataFrame) -> DataFrame:
    kind = lambda name: F.count_if(F.col("asset_type") == name)
    counted = assets.agg(
        F.count(F.lit(1)).alias("total_assets"),
        kind("dataset").alias("total_datasets"),
        kind("pipeline").alias("total_pipelines"),
        kind("model").alias("total_models"),
        F.coalesce(F.sum("download_count"), F.lit(0)).cast("bigint").alias("total_downloads"),
    )
    return beside(counted, installs.agg(F.count(F.lit(1)).alias("total_installs")))
