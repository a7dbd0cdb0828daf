"""The graph of what was made from what."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.governance import latest_scans
from sluice.session import materialize, stored

# Display color per node type.
COLORS = {
    "dataset": "#3b82f6",
    "pipeline": "#a855f7",
    "pipeline_run": "#7c3aed",
    "synthetic_job": "#14b8a6",
    "al_session": "#22c55e",
    "benchmark_job": "#f97316",
    "marketplace_asset": "#ec4899",
}


@dataclass
class Entities:
    """Catalog tables; ids are text and unique over all kinds but runs and assets."""

    datasets: DataFrame  # id, name, file_path, row_count, status, created_at
    scans: DataFrame
    pipelines: DataFrame  # id, name, dataset_id, status, step_count, created_at
    runs: DataFrame  # id, pipeline_id, status, output_path, rows_in, rows_out, created_at
    synthetic_jobs: DataFrame  # id, method, status, source_dataset_id, output_dataset_id, row_count, created_at
    sessions: DataFrame  # id, name, model_type, task_type, status, dataset_id, created_at
    rounds: DataFrame  # session_id, round, accuracy
    benchmarks: DataFrame  # id, name, status, task_type, dataset_id, candidate_count, created_at
    assets: DataFrame  # id, title, asset_type, author_name
    installs: DataFrame  # asset_id, resulting_id


def _nodes(df: DataFrame, kind: str, node_id: Column, label: Column, meta: list[str | Column]) -> DataFrame:
    return df.select(
        node_id.alias("id"), F.lit(kind).alias("type"), label.alias("label"), F.lit(COLORS[kind]).alias("color"),
        F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}).alias("meta"),
    )


def run_node(run_id: Column) -> Column:
    return F.concat(F.lit("prun_"), run_id)


def asset_node(asset_id: Column) -> Column:
    return F.concat(F.lit("mp_"), asset_id)


def nodes(e: Entities) -> DataFrame:
    """Everything that was made or used, with the facts of its kind as JSON."""
    risks = latest_scans(e.scans).select(F.col("dataset_id").alias("__id"), "overall_risk")
    sets = e.datasets.join(risks, F.col("id") == F.col("__id"), "left").withColumn(
        "pii_risk", F.coalesce("overall_risk", F.lit("unscanned"))
    )
    trained = e.rounds.groupBy(F.col("session_id").alias("__id")).agg(F.count(F.lit(1)).alias("rounds"), F.max_by("accuracy", "round").alias("accuracy"))
    sessions = e.sessions.join(trained, F.col("id") == F.col("__id"), "left").withColumn("rounds", F.coalesce("rounds", F.lit(0)))
    used = e.assets.join(e.installs, F.col("id") == F.col("asset_id"), "left_semi").withColumn("author", F.col("author_name"))
    col = F.col
    named = lambda fallback: F.coalesce(F.when(col("name") != "", col("name")), fallback)
    parts = [
        _nodes(sets, "dataset", col("id"), col("name"), ["row_count", "status", "pii_risk", "created_at"]),
        _nodes(e.pipelines, "pipeline", col("id"), col("name"), ["step_count", "status", "created_at"]),
        _nodes(e.runs, "pipeline_run", run_node(col("id")), F.format_string("Run (%s)", "status"), ["status", "rows_in", "rows_out", "created_at"]),
        _nodes(e.synthetic_jobs, "synthetic_job", col("id"), F.format_string("Synthetic (%s)", "method"), ["method", "row_count", "status", "created_at"]),
        _nodes(
            sessions, "al_session", col("id"), named(F.format_string("AL: %s", "model_type")),
            ["model_type", "task_type", "status", "rounds", "created_at", "accuracy"],
        ),
        _nodes(e.benchmarks, "benchmark_job", col("id"), named(F.lit("Benchmark")), ["candidate_count", "status", "task_type", "created_at"]),
        _nodes(used, "marketplace_asset", asset_node(col("id")), col("title"), ["asset_type", "author"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def _edges(df: DataFrame, source: Column, target: Column, label: str) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(label).alias("label"))


def edges(e: Entities) -> DataFrame:
    """The eight kinds of edges, where both ends exist."""
    col = F.col
    by_path = e.datasets.groupBy("file_path").agg(F.min("id").alias("made"))
    produced = e.runs.join(by_path, col("output_path") == col("file_path"))
    parts = [
        _edges(e.pipelines, col("dataset_id"), col("id"), "source of"),
        _edges(e.runs, col("pipeline_id"), run_node(col("id")), "executed as"),
        _edges(produced, run_node(col("id")), col("made"), "produces"),
        _edges(e.synthetic_jobs, col("source_dataset_id"), col("id"), "source of"),
        _edges(e.synthetic_jobs, col("id"), col("output_dataset_id"), "generates"),
        _edges(e.sessions, col("dataset_id"), col("id"), "trains on"),
        _edges(e.benchmarks, col("dataset_id"), col("id"), "evaluated on"),
        _edges(e.installs, asset_node(col("asset_id")), col("resulting_id"), "installed as"),
    ]
    # semi joins would be pushed into the union, and each of its parts joined with all nodes
    known = nodes(e).select(F.col("id").alias("known")).distinct()
    both = reduce(DataFrame.unionByName, parts)
    both = both.join(known, col("source") == col("known")).drop("known")
    both = both.join(known, col("target") == col("known"))
    return both.select(F.concat("source", F.lit("->"), "target").alias("id"), "source", "target", "label")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per type, next to the totals."""
    counts = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    lines = edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("type", "n", total.alias("total_nodes"), lines.alias("total_edges"))


SLICES = 8  # parts that the neighbours of one node are split into


def reach(edges: DataFrame, start: DataFrame, directed: bool) -> DataFrame:
    """Ids reachable from ``start(id)``, the start included.

    Each round joins only the nodes found in the round before. The steps are
    partitioned, sorted and cached once, so a round shuffles only those nodes;
    the steps of a hub lie in ``SLICES`` partitions. Rounds end when nothing new
    is found; every round is checkpointed, so the plan stays short and a lost
    executor repeats one round.
    """
    steps = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    if not directed:
        steps = steps.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = steps.distinct().withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(SLICES)).cast("int"))
    steps = steps.repartition(width, "a", "slice").sortWithinPartitions("a", "slice").persist()
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    try:
        frontier = materialize(start.select("id").distinct())
        rounds = [frontier]
        while True:
            wanted = frontier.select("id", slices.alias("of"))
            found = wanted.join(steps, (F.col("id") == F.col("a")) & (F.col("of") == F.col("slice"))).select(F.col("b").alias("id")).distinct()
            # without directions a neighbour is new or was found in this round or the one before
            seen = reduce(DataFrame.unionByName, rounds if directed else rounds[-2:])
            frontier = materialize(found.join(seen, "id", "left_anti"))
            if frontier.isEmpty():
                return reduce(DataFrame.unionByName, rounds)
            rounds.append(frontier)
    finally:
        steps.unpersist()


def related(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges connected with ``start`` in either direction."""
    edges = stored(edges)
    ids = reach(edges, start, directed=False)
    keep = ids.select(F.col("id").alias("__id"))
    # an edge that starts at a connected node also ends at one; ids are distinct, and an inner join stays above the union of nodes
    inside = edges.where(F.col("target").isNotNull()).join(keep, F.col("source") == F.col("__id"), "left_semi")
    return nodes.join(ids, "id").select(*nodes.columns), inside


def impact(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything downstream of ``start``."""
    below = reach(edges, start, directed=True).join(start.select("id"), "id", "left_anti")
    return nodes.join(below, "id", "left_semi").select("id", "type", "label")
