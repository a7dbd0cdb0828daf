"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
Every query runs to the end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sluice.operators import profile, quality  # noqa: E402
from sluice.plans import all_queries  # noqa: E402
from sluice.session import local_session  # noqa: E402


def full_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The yardstick: issues, scores and profiles of every column of lineitem."""
    scan = quality.Scan(spark.read.parquet(f"{folder}/lineitem.parquet"))
    seen = [scan.issues().select("column_name"), scan.profiles().selectExpr("name"), scan.scores().selectExpr("CAST(overall AS STRING)")]
    return seen[0].union(seen[1]).union(seen[2])


def wide_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts over twice the columns: the number of jobs must not grow."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    twice = lines.select("*", *[lines[c].alias(f"{c}_2") for c in lines.columns])
    return profile.facts(twice)


HEADLINES = (
    "q_overall",
    "q_issue_rank",
    "q_profile",
    "q_top_values",
    "step_filter_gt",
    "step_fill_mean",
    "step_encode",
    "step_dedup_subset",
    "chain_features",
    "chain_trace",
    "fix_chain",
    "fix_oversample",
    "fix_undersample",
    "pii_value_counts",
    "pii_findings",
    "anon_pseudonym",
    "anon_job",
    "gov_all_violations",
    "gov_risk",
    "lineage_edges",
    "lineage_reach",
    "audit_search",
    "catalog_ratings",
    "syn_bootstrap",
    "syn_copula",
    "al_entropy",
    "al_coreset",
    "bm_holdout",
    "bm_class_metrics",
    "bm_auc",
    "bm_grid_logistic_regression",
    "fid_ks",
    "out_votes",
    "noise_issues",
    "stream_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    known = all_queries()
    runs = {"full_scan": full_scan, "wide_scan": wide_scan, **{name: known[name] for name in HEADLINES}}
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    tracker = spark.sparkContext.statusTracker()
    seconds, jobs = {}, {}
    for name, query in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        started = time.time()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "jobs": jobs,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
