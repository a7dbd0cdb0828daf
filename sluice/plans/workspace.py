"""Catalog tables derived from the given ones: datasets, scans, pipelines, sessions and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import governance, lineage
from sluice.plans.tables import Derived, table

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-15 12:00:00"

_TEXT = "cast({} AS STRING)".format
_JOIN = "concat('{}', cast({} AS STRING))".format


def _day(key: str) -> str:
    return f"concat('2024-', cast(10 + {key} % 3 AS STRING), '-', cast(10 + {key} % 19 AS STRING))"


class Datasets:
    """Customers as datasets; their orders give the row count and the day of creation."""

    @staticmethod
    def frame(s: SparkSession, d: str) -> DataFrame:
        orders = table(s, d, "orders").groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first")
        )
        joined = table(s, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        odd = (F.col("c_custkey") % 50 == 0) | F.col("first").isNull()
        stamp = F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return joined.selectExpr(
            "*", _JOIN("ds", "c_custkey") + " AS id", _JOIN("out/", "c_custkey - c_custkey % 2") + " AS stem",
            "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 END AS latest_score",
        ).select(
            "id", F.col("c_name").alias("name"), (F.coalesce("n", F.lit(0)) * 6).alias("row_count"),
            F.lit(6).alias("column_count"), (F.coalesce("n", F.lit(0)) * 48).alias("size_bytes"),
            F.lit("ready").alias("status"), "latest_score",
            F.when(odd, "unknown").otherwise(stamp).alias("created_at"),
            F.concat("stem", F.lit(".csv")).alias("file_path"),
        )

    sql = """SELECT 'ds' || c_custkey AS id, c_name AS name, coalesce(n, 0) * 6 AS row_count, 6 AS column_count,
        coalesce(n, 0) * 48 AS size_bytes, 'ready' AS status,
        CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 END AS latest_score,
        CASE WHEN c_custkey % 50 = 0 OR first IS NULL THEN 'unknown' ELSE strftime(first, '%Y-%m-%dT%H:%M:%SZ') END AS created_at,
        'out/' || (c_custkey - c_custkey % 2) || '.csv' AS file_path
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first FROM orders GROUP BY 1)
        ON c_custkey = o_custkey"""


SCANS = Derived(
    "orders",
    {
        "id": _TEXT("o_orderkey"),
        "number": "o_orderkey",
        "dataset_id": "CASE WHEN o_custkey % 7 = 0 THEN concat('gone', cast(o_custkey AS STRING)) ELSE "
        + _JOIN("ds", "o_custkey") + " END",
        "status": "CASE o_orderstatus WHEN 'O' THEN 'failed' ELSE 'complete' END",
        "scanned_at": "o_orderdate",
        "overall_risk": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' "
        "WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'clean' END",
        "pii_column_count": "o_orderkey % 7",
        "critical_count": "o_orderkey % 3",
    },
)
PIPELINES = Derived(
    "part",
    {
        "id": _JOIN("pl", "p_partkey"),
        "name": "p_name",
        "dataset_id": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE " + _JOIN("ds", "p_partkey * 7 % 2500") + " END",
        "status": "'active'",
        "step_count": "p_size % 7",
        "created_at": _day("p_partkey"),
    },
)
RUNS = Derived(
    "orders",
    {
        "id": _TEXT("o_orderkey"),
        "pipeline_id": _JOIN("pl", "o_orderkey % 2500"),
        "status": "lower(o_orderstatus)",
        "rows_in": "o_custkey * 3",
        "rows_out": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey * 3 - o_orderkey % 10 END",
        "created_at": _day("o_orderkey"),
        "output_path": "CASE WHEN o_orderkey % 5 = 0 THEN concat('out/', cast(o_custkey % 1800 AS STRING), '.csv') END",
    },
)
SYNTHETIC = Derived(
    "supplier",
    {
        "id": _JOIN("sy", "s_suppkey"),
        "method": "CASE s_suppkey % 2 WHEN 0 THEN 'statistical' ELSE 'bootstrap' END",
        "status": "'complete'",
        "row_count": "s_suppkey * 100",
        "created_at": _day("s_suppkey"),
        "source_dataset_id": _JOIN("ds", "s_suppkey * 3"),
        "output_dataset_id": _JOIN("ds", "s_suppkey * 40"),
    },
)
SESSIONS = Derived(
    "supplier",
    {
        "id": _JOIN("al", "s_suppkey"),
        "name": "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END",
        "model_type": "'random_forest'",
        "task_type": "CASE WHEN s_suppkey % 3 = 0 THEN 'regression' ELSE 'classification' END",
        "created_at": _day("s_suppkey"),
        "status": "CASE WHEN s_suppkey % 5 = 0 THEN 'annotating' ELSE 'complete' END",
        "dataset_id": _JOIN("ds", "s_nationkey"),
    },
)
ROUNDS = Derived(
    "lineitem",
    {
        "session_id": _JOIN("al", "l_suppkey"),
        "round": "l_orderkey * 10 + l_linenumber",
        "labeled_count": "l_partkey",
        "accuracy": "CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_quantity / 50 END",
    },
)
BENCHMARKS = Derived(
    "part",
    {
        "id": _JOIN("bm", "p_partkey"),
        "name": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END",
        "status": "CASE p_size % 3 WHEN 0 THEN 'running' ELSE 'complete' END",
        "winner": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE " + _JOIN("c", "p_size") + " END",
        "dataset_id": _JOIN("ds", "p_partkey"),
        "candidate_count": "1 + p_size % 5",
        "task_type": "CASE WHEN p_size % 4 = 0 THEN 'regression' ELSE 'classification' END",
        "created_at": _day("p_partkey"),
    },
)
ASSETS = Derived(
    "part",
    {
        "id": "p_partkey",
        "title": "p_name",
        "description": "p_type",
        "brand": "p_brand",
        "author_name": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_brand END",
        "asset_type": "CASE p_size % 4 WHEN 0 THEN 'dataset' WHEN 1 THEN 'pipeline' WHEN 2 THEN 'model' ELSE 'benchmark' END",
        "category": "lower(p_type)",
        "status": "CASE WHEN p_partkey % 20 = 0 THEN 'draft' ELSE 'published' END",
        "download_count": "p_partkey * 31 % 997",
        "view_count": "p_partkey * 37 % 1009",
        "published_at": "p_partkey * 7919 % 10007",
        "rating_avg": "CAST(p_size % 5 AS DOUBLE)",
        "rating_count": "p_partkey % 11",
    },
)
INSTALLS = Derived(
    "events", {"asset_id": "user_id", "resulting_id": _JOIN("ds", "event_id % 2000"), "installed_at": "ts"}
)
REVIEWS = Derived("lineitem", {"asset_id": "l_partkey * 2", "rating": "1 + l_quantity % 5"})
AUDIT = Derived(
    "events",
    {
        "id": "event_id",
        "event_type": "CASE event_type WHEN 'click' THEN 'dataset.click' WHEN 'view' THEN 'pipeline.view' "
        "WHEN 'error' THEN 'compliance.pii_scan' WHEN 'purchase' THEN 'marketplace.install' ELSE 'account.signup' END",
        "entity_type": "'dataset'",
        "entity_id": _JOIN("ds", "user_id"),
        "entity_name": "concat('Set ', cast(user_id AS STRING), ' ', event_type)",
        "duration_ms": "event_id % 1000",
        "created_at": "ts",
        "metadata": "props",
    },
)
REQUESTS = Derived(
    "events",
    {
        "id": "event_id",
        "status": "CASE event_id % 3 WHEN 0 THEN 'approved' ELSE 'pending' END",
        "auto_approve_at": "CASE WHEN event_type IN ('view', 'click') THEN ts + INTERVAL 24 HOURS END",
    },
)
JOBS = Derived(
    "events",
    {
        "id": "event_id",
        "kind": "CASE event_id % 4 WHEN 0 THEN 'synthetic_job' WHEN 1 THEN 'benchmark_job' WHEN 2 THEN 'al_session' "
        "ELSE 'pipeline_run' END",
        "status": "CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'training' ELSE 'complete' END",
        "created_at": "ts",
    },
)


def _finding(column: str, category: str, severity: str, confidence: str, method: str):
    return F.struct(
        F.lit(column).alias("column"), F.lit(category).alias("pii_category"), F.lit(severity).alias("severity"),
        F.lit(float(confidence)).alias("confidence"), F.lit(method).alias("detection_method"),
    )


def scans(s: SparkSession, d: str) -> DataFrame:
    note = _finding("note", "contact", "high", "0.8", "value_pattern")
    card = _finding("card", "financial", "critical", "0.9", "column_name")
    both = F.when(F.col("number") % 3 == 0, F.array(note, card)).otherwise(F.array(note))
    return SCANS.frame(s, d).withColumn("findings", both)


def catalog(s: SparkSession, d: str) -> governance.Catalog:
    return governance.Catalog(
        Datasets.frame(s, d), scans(s, d), PIPELINES.frame(s, d), SESSIONS.frame(s, d), ROUNDS.frame(s, d),
        BENCHMARKS.frame(s, d),
    )


def assets(s: SparkSession, d: str) -> DataFrame:
    return ASSETS.frame(s, d).withColumn("tags", F.split("title", " "))


def entities(s: SparkSession, d: str) -> lineage.Entities:
    shown = ASSETS.frame(s, d).withColumn("id", F.col("id").cast("string"))
    installs = INSTALLS.frame(s, d).withColumn("asset_id", F.col("asset_id").cast("string"))
    return lineage.Entities(
        Datasets.frame(s, d), scans(s, d), PIPELINES.frame(s, d), RUNS.frame(s, d), SYNTHETIC.frame(s, d),
        SESSIONS.frame(s, d), ROUNDS.frame(s, d), BENCHMARKS.frame(s, d), shown, installs,
    )
