"""Policies, risk and compliance reports over catalog tables.

Inputs are plain DataFrames:
``datasets(id, name, row_count, column_count, size_bytes, status, latest_score, created_at, file_path)``,
``scans(id, dataset_id, status, scanned_at, overall_risk, pii_column_count, critical_count, findings)``,
``pipelines(id, name, dataset_id)``, ``sessions(id, name, status)``, ``rounds(session_id, round, accuracy)``,
``benchmarks(id, name, status, winner)`` and violations as made here. Ids are text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scalars import beside
from sluice.functions.times import age_days, as_time, moment
from sluice.operators.pii import RANKS, rank_of
from sluice.session import small_frame

# Name, type, parameters and severity of the policies every
# workspace starts with. Scores are on a scale of 0 to 100.
DEFAULT_POLICIES = (
    ("No critical PII in training data", "no_pii_in_training", {"max_pii_severity": "critical"}, "critical"),
    ("PII scan required within 30 days", "pii_scan_required", {"max_days": 30}, "warning"),
    ("Minimum quality score 60", "min_quality_score", {"threshold": 60.0}, "warning"),
    ("Dataset retention max 365 days", "max_retention_days", {"max_days": 365}, "info"),
    ("Minimum 50 rows for training", "min_row_count_for_training", {"min_rows": 50}, "warning"),
    ("No unscanned datasets in pipelines", "no_unscanned_in_pipeline", {}, "warning"),
    ("Model accuracy floor 70%", "model_accuracy_floor", {"threshold": 0.70}, "warning"),
    ("Benchmark must have winner before use", "benchmark_winner_required", {}, "info"),
)
RISK_WEIGHTS = {"pii_exposure": 40, "policy_failures": 30, "scan_coverage": 20, "data_freshness": 10}
GRADES = ((90, "A"), (80, "B+"), (70, "B"), (60, "C"), (50, "D"))
STALE_DAYS = 365
STANDARD_FRAMEWORKS = ("gdpr", "ccpa", "hipaa", "general")


@dataclass
class Catalog:
    datasets: DataFrame
    scans: DataFrame
    pipelines: DataFrame
    sessions: DataFrame
    rounds: DataFrame
    benchmarks: DataFrame


def default_policies() -> list[dict]:
    return [
        {"id": kind, "name": name, "policy_type": kind, "parameters": parameters, "severity": level, "enabled": True}
        for name, kind, parameters, level in DEFAULT_POLICIES
    ]


def latest_scans(scans: DataFrame) -> DataFrame:
    """The newest complete scan per dataset, as an aggregate without a window."""
    done = scans.where(F.col("status") == "complete")
    kept = [c for c in ("overall_risk", "pii_column_count", "critical_count") if c in scans.columns]
    newest = done.groupBy("dataset_id").agg(F.max(F.struct("scanned_at", "id", *kept)).alias("s"))
    return newest.select("dataset_id", F.col("s.id").alias("scan_id"), "s.scanned_at", *[f"s.{c}" for c in kept])


def with_latest_scan(catalog: Catalog) -> DataFrame:
    latest = latest_scans(catalog.scans)
    return catalog.datasets.join(latest, F.col("id") == F.col("dataset_id"), "left").drop("dataset_id")


# --- policies -----------------------------------------------------------------


def _violations(found: DataFrame, policy: dict, entity: str, name: Column, message: Column) -> DataFrame:
    key = F.concat_ws("|", F.lit(str(policy["id"])), F.lit(entity), F.col("id"))
    return found.select(
        F.md5(key).alias("id"),
        F.lit(str(policy["id"])).alias("policy_id"),
        F.lit(policy["name"]).alias("policy_name"),
        F.lit(policy["policy_type"]).alias("policy_type"),
        F.lit(entity).alias("entity_type"),
        F.col("id").alias("entity_id"),
        name.alias("entity_name"),
        message.alias("message"),
        F.lit(policy["severity"]).alias("severity"),
    )


def _on_datasets(found: DataFrame, policy: dict, message: Column) -> DataFrame:
    return _violations(found, policy, "dataset", F.col("name"), message)


def _named(column: str = "name") -> Column:
    return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.col("id"))


def no_pii_in_training(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    worst = policy["parameters"].get("max_pii_severity", "critical")
    latest = latest_scans(catalog.scans)
    risky = latest.where(rank_of(F.col("overall_risk")) >= RANKS.get(worst, 0))
    found = catalog.datasets.join(risky, F.col("id") == F.col("dataset_id"))
    text = F.format_string(f"Dataset has %s PII risk (%d PII columns). Max allowed: {worst}.", "overall_risk", "pii_column_count")
    return _on_datasets(found, policy, text)


def pii_scan_required(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    days = policy["parameters"].get("max_days", 30)
    age = age_days("scanned_at", as_of)
    found = with_latest_scan(catalog).where(F.col("scan_id").isNull() | (age > days))
    old = F.format_string(f"PII scan is %d days old (max: {days} days).", F.floor(age))
    text = F.when(F.col("scan_id").isNull(), "Dataset has never been scanned for PII.").otherwise(old)
    return _on_datasets(found, policy, text)


def min_quality_score(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    floor = float(policy["parameters"].get("threshold", 60.0))
    found = catalog.datasets.where(F.col("latest_score") < floor)
    return _on_datasets(found, policy, F.format_string(f"Quality score %.2f is below threshold {floor:.2f}.", "latest_score"))


def max_retention_days(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    days = policy["parameters"].get("max_days", 365)
    age = age_days("created_at", as_of)
    found = catalog.datasets.where(age > days)
    return _on_datasets(found, policy, F.format_string(f"Dataset is %d days old (max: {days} days).", F.floor(age)))


def min_row_count_for_training(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    rows = policy["parameters"].get("min_rows", 50)
    found = catalog.datasets.where(F.col("row_count") < rows)
    return _on_datasets(found, policy, F.format_string(f"Dataset has only %d rows (minimum: {rows}).", "row_count"))


def no_unscanned_in_pipeline(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    unscanned = with_latest_scan(catalog).where("scan_id IS NULL")
    sources = unscanned.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    found = catalog.pipelines.join(sources, F.col("dataset_id") == F.col("source_id"))
    text = F.format_string("Source dataset '%s' has not been scanned for PII.", "source_name")
    return _violations(found, policy, "pipeline", F.col("name"), text)


def model_accuracy_floor(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    floor = float(policy["parameters"].get("threshold", 0.70))
    last = catalog.rounds.groupBy("session_id").agg(F.max_by("accuracy", "round").alias("accuracy"))
    done = catalog.sessions.where(F.col("status") == "complete")
    found = done.join(last.where(F.col("accuracy") < floor), F.col("id") == F.col("session_id"))
    text = F.format_string(f"Model accuracy %.2f%% is below floor {floor * 100:.2f}%%.", F.col("accuracy") * 100)
    return _violations(found, policy, "al_session", _named(), text)


def benchmark_winner_required(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    found = catalog.benchmarks.where((F.col("status") == "complete") & F.col("winner").isNull())
    return _violations(found, policy, "benchmark_job", _named(), F.lit("Benchmark completed but no winner was determined."))


RULES = {
    rule.__name__: rule
    for rule in (
        no_pii_in_training, pii_scan_required, min_quality_score, max_retention_days, min_row_count_for_training,
        no_unscanned_in_pipeline, model_accuracy_floor, benchmark_winner_required,
    )
}


def evaluate(catalog: Catalog, policy: dict, as_of: str) -> DataFrame:
    return RULES[policy["policy_type"]](catalog, policy, as_of)


def evaluate_all(catalog: Catalog, policies: Sequence[dict], as_of: str) -> DataFrame:
    """Violations of all enabled policies, as open violations detected at ``as_of``."""
    parts = [evaluate(catalog, p, as_of) for p in policies if p.get("enabled", True) and p["policy_type"] in RULES]
    return reduce(DataFrame.unionByName, parts).select(
        "*", F.lit(False).alias("resolved"), moment(as_of).alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at")
    )


def replace_violations(old: DataFrame, new: DataFrame, policies: Sequence[dict]) -> DataFrame:
    """Old violations of policies that were evaluated give way to the new ones."""
    evaluated = [str(p["id"]) for p in policies if p.get("enabled", True)]
    return old.where(~F.col("policy_id").isin(evaluated)).unionByName(new)


def resolve(violations: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Mark the violations whose id is in ``ids(id)`` as resolved."""
    marked = ids.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    joined = violations.join(marked, F.col("id") == F.col("__id"), "left")
    return joined.withColumns(
        {
            "resolved_at": F.when(hit & ~F.col("resolved"), moment(as_of)).otherwise(F.col("resolved_at")),
            "resolved": F.col("resolved") | hit,
        }
    ).select(*violations.columns)


def by_state(violations: DataFrame, resolved: bool = False) -> DataFrame:
    """Violations of one state, newest first."""
    return violations.where(F.col("resolved") == F.lit(resolved)).orderBy(F.col("detected_at").desc(), "id")


def policies_table(spark, policies: Sequence[dict]) -> DataFrame:
    rows = [(i, str(p["id"]), p["name"], p["policy_type"], p["severity"], bool(p.get("enabled", True))) for i, p in enumerate(policies)]
    schema = "policy_no int, policy_id string, name string, policy_type string, severity string, enabled boolean"
    return small_frame(spark, rows, schema)


def violation_counts(policies: DataFrame, violations: DataFrame) -> DataFrame:
    """Open violations per policy, zero included."""
    open_ones = violations.where(~F.col("resolved")).groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"))
    return policies.join(open_ones, "policy_id", "left").select(
        *policies.columns, F.coalesce("n", F.lit(0)).alias("violation_count")
    )


def policy_status(policies: DataFrame, violations: DataFrame, shown: int = 5) -> DataFrame:
    """Pass or fail per policy with its first violations as JSON.

    Spark keeps only the first rows per policy already before the shuffle.
    """
    open_ones = violations.where(~F.col("resolved"))
    order = Window.partitionBy("policy_id").orderBy(F.col("detected_at").desc(), "entity_id")
    first = open_ones.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown)
    entry = F.struct("place", F.col("entity_name").alias("entity"), "message")
    listed = first.groupBy("policy_id").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    shown_as = F.transform("v", lambda v: F.struct(v["entity"].alias("entity"), v["message"].alias("message")))
    counted = violation_counts(policies, violations).join(listed, "policy_id", "left")
    return counted.select(
        *policies.columns,
        F.when(F.col("violation_count") > 0, "fail").otherwise("pass").alias("status"),
        "violation_count",
        F.coalesce(F.to_json(shown_as), F.lit("[]")).alias("violations"),
    )


# --- risk ---------------------------------------------------------------------


def risk_score(catalog: Catalog, violations: DataFrame, as_of: str) -> DataFrame:
    """One row: score 0 to 100, grade, the four parts and how much each has lost."""
    risk = F.col("overall_risk")
    sets = with_latest_scan(catalog).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(risk == "critical").alias("critical_sets"),
        F.count_if(risk == "high").alias("high_sets"),
        F.count("scan_id").alias("scanned"),
        F.count_if(age_days("created_at", as_of) > STALE_DAYS).alias("stale"),
    )
    opened = violations.where(~F.col("resolved")).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_open"),
        F.count_if(F.col("severity") == "warning").alias("warning_open"),
    )
    n = F.col
    parts = beside(sets, opened).select(
        "total",
        (40 - F.least(F.lit(40), n("critical_sets") * 15 + n("high_sets") * 7)).alias("pii_exposure"),
        (30 - F.least(F.lit(30), n("critical_open") * 10 + n("warning_open") * 4)).alias("policy_failures"),
        F.floor(20 * (n("scanned") / F.greatest(n("total"), F.lit(1)))).alias("scan_coverage"),
        F.greatest(F.lit(0), 10 - n("stale") * 3).alias("data_freshness"),
    )
    empty = n("total") == 0
    score = F.when(empty, F.lit(100)).otherwise(reduce(lambda a, b: a + b, [n(c) for c in RISK_WEIGHTS]))
    grade = F.lit("F")
    for least, letter in reversed(GRADES):
        grade = F.when(score >= least, letter).otherwise(grade)
    lost = [
        F.when(n(c) < top, F.bround((1 - n(c) / top) * 100)).otherwise(0).cast("int").alias(f"{c}_pct")
        for c, top in RISK_WEIGHTS.items()
    ]
    return parts.select(
        score.cast("int").alias("score"), grade.alias("grade"), *[n(c).cast("int").alias(c) for c in RISK_WEIGHTS], *lost
    )


def dashboard(catalog: Catalog, violations: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """One row of counts for the overview."""
    risk = F.col("overall_risk")
    sets = with_latest_scan(catalog).agg(
        F.count_if(F.col("scan_id").isNull()).alias("unscanned_datasets"),
        F.coalesce(F.sum("pii_column_count"), F.lit(0)).cast("bigint").alias("pii_columns"),
        F.count_if(risk == "critical").alias("critical_pii_datasets"),
        F.count_if(risk == "high").alias("high_pii_datasets"),
    )
    opened = violations.agg(F.count_if(~F.col("resolved")).alias("violations"))
    since = moment(as_of) - F.expr("INTERVAL 7 DAYS")
    recent = events.agg(F.count_if(as_time("created_at") >= since).alias("audit_events_7d"))
    return beside(sets, opened, recent)


def coverage(catalog: Catalog) -> DataFrame:
    return with_latest_scan(catalog).select(
        "id", "name", F.coalesce("overall_risk", F.lit("unscanned")).alias("pii_risk"),
        F.coalesce("pii_column_count", F.lit(0)).alias("pii_column_count"),
        F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
    )


# --- report sections ------------------------------------------------------------


def inventory(catalog: Catalog, as_of: str) -> DataFrame:
    wanted = ("id", "name", "row_count", "column_count", "size_bytes", "status")
    return with_latest_scan(catalog).select(
        *[c for c in wanted if c in catalog.datasets.columns],
        F.coalesce("overall_risk", F.lit("unscanned")).alias("pii_risk"),
        F.col("pii_column_count").alias("pii_columns"),
        F.col("critical_count").alias("critical_columns"),
        F.col("latest_score").alias("quality_score"),
        F.round(age_days("created_at", as_of), 1).alias("age_days"),
        "created_at",
    )


def findings(catalog: Catalog) -> DataFrame:
    """One row per finding of all complete scans, with the dataset's name where it is known."""
    done = catalog.scans.where(F.col("status") == "complete").select("dataset_id", F.explode("findings").alias("f"))
    names = catalog.datasets.select(F.col("id").alias("__id"), F.col("name").alias("dataset_name"))
    return done.join(names, F.col("dataset_id") == F.col("__id"), "left").select(
        "dataset_id", F.coalesce("dataset_name", "dataset_id").alias("dataset_name"), "f.*"
    )


def recommendations(inventory: DataFrame, findings: DataFrame, status: DataFrame) -> DataFrame:
    """What to do next, as ordered lines."""
    sets = inventory.agg(
        F.count_if(F.col("pii_risk") == "unscanned").alias("unscanned"), F.count_if(F.col("age_days") > 365).alias("old")
    )
    critical = findings.where(F.col("severity") == "critical").select("dataset_name").distinct()
    three = critical.orderBy("dataset_name").limit(3)
    names = three.agg(F.concat_ws(", ", F.array_sort(F.collect_list("dataset_name"))).alias("names"))
    failing = status.agg(
        F.count_if((F.col("status") == "fail") & (F.col("severity") == "critical")).alias("failing")
    )
    one = beside(sets, names, failing)
    lines = F.array(
        F.when(F.col("unscanned") > 0, F.format_string("Scan %d unscanned dataset(s) for PII exposure.", "unscanned")),
        F.when(F.col("names") != "", F.format_string("Anonymize critical PII columns in: %s.", "names")),
        F.when(F.col("failing") > 0, F.format_string("Resolve %d critical policy violation(s) immediately.", "failing")),
        F.when(F.col("old") > 0, F.format_string("Review %d dataset(s) older than 1 year for retention compliance.", "old")),
    )
    kept = F.filter(lines, lambda x: x.isNotNull())
    none = F.array(F.lit("No immediate actions required. Continue regular PII scanning."))
    return one.select(F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(none)).alias("place", "recommendation"))


def report_sections(framework: str, sections: Sequence[str]) -> list[str]:
    """Which sections a report holds: those asked for and those its framework implies."""
    standard = framework in STANDARD_FRAMEWORKS
    implied = {
        "dataset_inventory": standard,
        "pii_findings": standard,
        "policy_status": framework == "general",
        "lineage_summary": False,
        "audit_excerpt": False,
        "recommendations": framework == "general",
    }
    return [name for name, always in implied.items() if always or name in sections]


def report(framework: str, sections: Sequence[str], available: dict[str, DataFrame], risk: DataFrame) -> DataFrame:
    """All rows of a report as ``section, body`` (JSON), ready for a JSON sink."""
    body = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    parts = [risk.select(F.lit("risk").alias("section"), body(risk).alias("body"))]
    for name in report_sections(framework, sections):
        df = available[name]
        parts.append(df.select(F.lit(name).alias("section"), body(df).alias("body")))
    return reduce(DataFrame.unionByName, parts).select(F.lit(framework).alias("framework"), "section", "body")


# --- time-outs ------------------------------------------------------------------


def resolve_deadlines(requests: DataFrame, as_of: str) -> DataFrame:
    """Pending requests whose time is up become approved."""
    due = F.coalesce((F.col("status") == "pending") & (as_time("auto_approve_at") <= moment(as_of)), F.lit(False))
    return requests.withColumn("reviewed_at", F.when(due, moment(as_of))).withColumn(
        "status", F.when(due, "auto_approved").otherwise(F.col("status"))
    )


# Which state may hang, and what a hanging job becomes.
STALE_STATES = {
    "synthetic_job": ("running", "failed"),
    "benchmark_job": ("running", "failed"),
    "al_session": ("training", "annotating"),
    "pipeline_run": ("running", "failed"),
}


def reset_stale(jobs: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Jobs (``kind, status, created_at``) that have hung for too long get their end state."""
    late = as_time("created_at") < moment(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    status = F.col("status")
    failed = F.lit(False)
    for kind, (hanging, end) in STALE_STATES.items():
        hit = late & (F.col("kind") == kind) & (F.col("status") == hanging)
        status = F.when(hit, end).otherwise(status)
        failed = failed | (hit if end == "failed" else F.lit(False))
    message = F.when(failed, "Interrupted by server restart")
    return jobs.withColumns({"error_message": message, "status": status})
