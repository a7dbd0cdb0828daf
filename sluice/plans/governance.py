"""Policies, risk, reports and time-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import audit, governance, lineage
from sluice.plans import workspace as w
from sluice.plans.tables import scratch
from sluice.sources import sinks

POLICIES = governance.default_policies()
BY_TYPE = {p["policy_type"]: p for p in POLICIES}
_SHOWN = ("policy_type", "entity_type", "entity_id", "entity_name", "message", "severity")


def _policy(kind: str):
    return lambda s, d: governance.evaluate(w.catalog(s, d), BY_TYPE[kind], w.AS_OF).select(*_SHOWN)


def violations(s: SparkSession, d: str) -> DataFrame:
    """All violations; those of every third dataset are resolved."""
    found = governance.evaluate_all(w.catalog(s, d), POLICIES, w.AS_OF)
    ids = found.where((F.col("entity_type") == "dataset") & (F.substring("entity_id", 3, 20).try_cast("int") % 3 == 0))
    return governance.resolve(found, ids.select("id"), w.AS_OF)


def _replaced(s: SparkSession, d: str) -> DataFrame:
    """Re-evaluating one policy leaves the violations of the others."""
    old = governance.evaluate_all(w.catalog(s, d), POLICIES, "1999-01-01 00:00:00")
    again = [BY_TYPE["max_retention_days"], BY_TYPE["pii_scan_required"]]
    new = governance.evaluate_all(w.catalog(s, d), again, w.AS_OF)
    merged = governance.replace_violations(old, new, again)
    return merged.groupBy("policy_type").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("detected_at"), "yyyy-MM-dd").alias("detected")
    )


def _listed(s: SparkSession, d: str) -> DataFrame:
    return governance.by_state(violations(s, d), resolved=True).select(
        "policy_type", "entity_id", "resolved", F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved_day")
    )


def _status(s: SparkSession, d: str) -> DataFrame:
    return governance.policy_status(governance.policies_table(s, POLICIES), violations(s, d))


def _recommend(s: SparkSession, d: str) -> DataFrame:
    cat = w.catalog(s, d)
    return governance.recommendations(governance.inventory(cat, w.AS_OF), governance.findings(cat), _status(s, d))


def _sections(s: SparkSession, d: str) -> DataFrame:
    """A general report with all sections, written as JSON and read back."""
    cat, entities = w.catalog(s, d), w.entities(s, d)
    found = violations(s, d)
    log = audit.categorized(w.AUDIT.frame(s, d))
    available = {
        "dataset_inventory": governance.inventory(cat, w.AS_OF),
        "pii_findings": governance.findings(cat),
        "policy_status": governance.policy_status(governance.policies_table(s, POLICIES), found),
        "lineage_summary": lineage.summary(lineage.nodes(entities), lineage.edges(entities)),
        "audit_excerpt": audit.excerpt(log),
        "recommendations": _recommend(s, d),
    }
    risk = governance.risk_score(cat, found, w.AS_OF)
    rows = governance.report("general", ["lineage_summary", "audit_excerpt"], available, risk)
    path = sinks.save_output(rows, scratch(s, "report"), "json")
    return s.read.schema("framework string, section string, body string").json(path)


def _stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss") for c in names})


QUERIES = {
    "gov_latest_scan": lambda s, d: governance.latest_scans(w.scans(s, d)).withColumn(
        "scanned_at", F.date_format("scanned_at", "yyyy-MM-dd")
    ),
    **{f"gov_policy_{kind}": _policy(kind) for kind in BY_TYPE},
    "gov_all_violations": lambda s, d: governance.evaluate_all(w.catalog(s, d), POLICIES, w.AS_OF).select(*_SHOWN),
    "gov_replaced": _replaced,
    "gov_risk": lambda s, d: governance.risk_score(w.catalog(s, d), violations(s, d), w.AS_OF),
    "gov_dashboard": lambda s, d: governance.dashboard(
        w.catalog(s, d), violations(s, d), w.AUDIT.frame(s, d), w.EVENTS_AS_OF
    ),
    "gov_coverage": lambda s, d: governance.coverage(w.catalog(s, d)),
    "gov_policy_counts": lambda s, d: governance.violation_counts(
        governance.policies_table(s, POLICIES), violations(s, d)
    ),
    "gov_resolve": _listed,
    "gov_inventory": lambda s, d: governance.inventory(w.catalog(s, d), w.AS_OF),
    "gov_findings": lambda s, d: governance.findings(w.catalog(s, d)),
    "gov_policy_status": _status,
    "gov_recommend": _recommend,
    "gov_report": _sections,
    "deadline_resolve": lambda s, d: _stamped(
        governance.resolve_deadlines(w.REQUESTS.frame(s, d), w.EVENTS_AS_OF), "auto_approve_at", "reviewed_at"
    ),
    "stale_reset": lambda s, d: governance.reset_stale(w.JOBS.frame(s, d), w.EVENTS_AS_OF).drop("created_at"),
}

# --- the same in SQL ----------------------------------------------------------

_AS_OF = f"TIMESTAMP '{w.AS_OF}'"
_AGE = f"coalesce((epoch_us({_AS_OF}) - epoch_us(try_cast({{c}} AS TIMESTAMP))) / 86400000000.0, 0)"
BASE = f"""WITH datasets AS MATERIALIZED ({w.Datasets.sql}), scans AS MATERIALIZED ({w.SCANS.sql}),
    latest AS MATERIALIZED (SELECT * EXCLUDE (place) FROM (SELECT dataset_id, id AS scan_id, scanned_at, overall_risk,
        pii_column_count, critical_count, row_number() OVER (PARTITION BY dataset_id ORDER BY scanned_at DESC, id DESC) AS place
        FROM scans WHERE status = 'complete') WHERE place = 1),
    d AS MATERIALIZED (SELECT datasets.*, latest.* EXCLUDE (dataset_id), {_AGE.format(c='created_at')} AS age,
        {_AGE.format(c='scanned_at')} AS scan_age FROM datasets LEFT JOIN latest ON id = dataset_id),
    pipelines AS ({w.PIPELINES.sql}), sessions AS ({w.SESSIONS.sql}), rounds AS ({w.ROUNDS.sql}),
    benchmarks AS ({w.BENCHMARKS.sql}),
    last_round AS (SELECT session_id, arg_max(struct_pack(a := accuracy), round).a AS accuracy FROM rounds GROUP BY 1)"""
_RULE_SQL = {
    "no_pii_in_training": """SELECT 'no_pii_in_training' AS policy_type, 'dataset' AS entity_type, id AS entity_id,
        name AS entity_name, 'Dataset has ' || overall_risk || ' PII risk (' || pii_column_count
        || ' PII columns). Max allowed: critical.' AS message, 'critical' AS severity FROM d WHERE overall_risk = 'critical'""",
    "pii_scan_required": """SELECT 'pii_scan_required' AS policy_type, 'dataset' AS entity_type, id AS entity_id,
        name AS entity_name, CASE WHEN scan_id IS NULL THEN 'Dataset has never been scanned for PII.' ELSE 'PII scan is '
        || CAST(floor(scan_age) AS BIGINT) || ' days old (max: 30 days).' END AS message, 'warning' AS severity FROM d
        WHERE scan_id IS NULL OR scan_age > 30""",
    "min_quality_score": """SELECT 'min_quality_score' AS policy_type, 'dataset' AS entity_type, id AS entity_id,
        name AS entity_name, printf('Quality score %.2f is below threshold 60.00.', latest_score) AS message,
        'warning' AS severity FROM d WHERE latest_score < 60""",
    "max_retention_days": """SELECT 'max_retention_days' AS policy_type, 'dataset' AS entity_type, id AS entity_id,
        name AS entity_name, 'Dataset is ' || CAST(floor(age) AS BIGINT) || ' days old (max: 365 days).' AS message,
        'info' AS severity FROM d WHERE age > 365""",
    "min_row_count_for_training": """SELECT 'min_row_count_for_training' AS policy_type, 'dataset' AS entity_type,
        id AS entity_id, name AS entity_name, 'Dataset has only ' || row_count || ' rows (minimum: 50).' AS message,
        'warning' AS severity FROM d WHERE row_count < 50""",
    "no_unscanned_in_pipeline": """SELECT 'no_unscanned_in_pipeline' AS policy_type, 'pipeline' AS entity_type,
        p.id AS entity_id, p.name AS entity_name, 'Source dataset ''' || d.name || ''' has not been scanned for PII.' AS message,
        'warning' AS severity FROM pipelines p JOIN d ON p.dataset_id = d.id WHERE d.scan_id IS NULL""",
    "model_accuracy_floor": """SELECT 'model_accuracy_floor' AS policy_type, 'al_session' AS entity_type, id AS entity_id,
        CASE WHEN name = '' THEN id ELSE name END AS entity_name, printf('Model accuracy %.2f%% is below floor 70.00%%.',
        accuracy * 100) AS message, 'warning' AS severity FROM sessions JOIN last_round ON id = session_id
        WHERE status = 'complete' AND accuracy < 0.7""",
    "benchmark_winner_required": """SELECT 'benchmark_winner_required' AS policy_type, 'benchmark_job' AS entity_type,
        id AS entity_id, CASE WHEN name = '' THEN id ELSE name END AS entity_name,
        'Benchmark completed but no winner was determined.' AS message, 'info' AS severity FROM benchmarks
        WHERE status = 'complete' AND winner IS NULL""",
}
_ALL = " UNION ALL ".join(_RULE_SQL.values())
_V = f"""v AS MATERIALIZED (SELECT *, entity_type = 'dataset' AND TRY_CAST(substr(entity_id, 3) AS INTEGER) % 3 = 0
    AS resolved FROM ({_ALL}))"""
_POLICIES = ", ".join(
    f"({i}, '{p['id']}', '{p['name']}', '{p['policy_type']}', '{p['severity']}', true)" for i, p in enumerate(POLICIES)
)
_P = f"p(policy_no, policy_id, name, policy_type, severity, enabled) AS (VALUES {_POLICIES})"
_STATUS = f"""st AS MATERIALIZED (SELECT p.*, CASE WHEN count(v.entity_id) > 0 THEN 'fail' ELSE 'pass' END AS status,
    count(v.entity_id) AS violation_count FROM p LEFT JOIN v ON p.policy_type = v.policy_type AND NOT v.resolved
    GROUP BY ALL)"""
_FIRST = """f5 AS (SELECT policy_type, '[' || string_agg('{"entity":"' || entity_name || '","message":"' || message || '"}', ','
    ORDER BY place) || ']' AS violations FROM (SELECT *, row_number() OVER (PARTITION BY policy_type ORDER BY entity_id) AS place
    FROM v WHERE NOT resolved) WHERE place <= 5 GROUP BY 1)"""
_FINDINGS = """fi AS (SELECT scans.dataset_id, coalesce(datasets.name, scans.dataset_id) AS dataset_name, x.* FROM scans
    LEFT JOIN datasets ON scans.dataset_id = datasets.id, (VALUES (1, 'note', 'contact', 'high', 0.8::DOUBLE, 'value_pattern'),
    (3, 'card', 'financial', 'critical', 0.9::DOUBLE, 'column_name')) x(every, "column", pii_category, severity, confidence,
    detection_method) WHERE scans.status = 'complete' AND number % every = 0)"""
_RISK = f"""parts AS (SELECT
    40 - least(40, 15 * count(*) FILTER (overall_risk = 'critical') + 7 * count(*) FILTER (overall_risk = 'high')) AS pii_exposure,
    30 - least(30, 10 * (SELECT count(*) FROM v WHERE NOT resolved AND severity = 'critical')
        + 4 * (SELECT count(*) FROM v WHERE NOT resolved AND severity = 'warning')) AS policy_failures,
    CAST(floor(20.0 * count(scan_id) / count(*)) AS INTEGER) AS scan_coverage,
    greatest(0, 10 - 3 * count(*) FILTER (age > 365)) AS data_freshness FROM d),
    sc AS (SELECT *, pii_exposure + policy_failures + scan_coverage + data_freshness AS score FROM parts)"""
_EVENT_AS_OF = f"TIMESTAMP '{w.EVENTS_AS_OF}'"

SQL = {
    "gov_latest_scan": f"{BASE} SELECT * REPLACE (strftime(scanned_at, '%Y-%m-%d') AS scanned_at) FROM latest",
    **{f"gov_policy_{kind}": f"{BASE} {text}" for kind, text in _RULE_SQL.items()},
    "gov_all_violations": f"{BASE} {_ALL}",
    "gov_replaced": f"""{BASE}, o AS ({_ALL}), early AS (SELECT id, name,
        coalesce((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(try_cast(created_at AS TIMESTAMP))) / 86400000000.0, 0) AS age FROM d)
        SELECT policy_type, count(*) AS n, CASE WHEN policy_type IN ('max_retention_days', 'pii_scan_required')
        THEN '2001-08-02' ELSE '1999-01-01' END AS detected FROM o GROUP BY 1""",
    "gov_risk": f"""{BASE}, {_V}, {_RISK} SELECT CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'A'
        WHEN score >= 80 THEN 'B+' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END
        AS grade, CAST(pii_exposure AS INTEGER) AS pii_exposure, CAST(policy_failures AS INTEGER) AS policy_failures,
        scan_coverage, CAST(data_freshness AS INTEGER) AS data_freshness,
        CAST(round_even((1 - pii_exposure / 40.0) * 100, 0) AS INTEGER) AS pii_exposure_pct,
        CAST(round_even((1 - policy_failures / 30.0) * 100, 0) AS INTEGER) AS policy_failures_pct,
        CAST(round_even((1 - scan_coverage / 20.0) * 100, 0) AS INTEGER) AS scan_coverage_pct,
        CAST(round_even((1 - data_freshness / 10.0) * 100, 0) AS INTEGER) AS data_freshness_pct FROM sc""",
    "gov_dashboard": f"""{BASE}, {_V}, e AS ({w.AUDIT.sql}) SELECT count(*) FILTER (scan_id IS NULL) AS unscanned_datasets,
        CAST(sum(pii_column_count) AS BIGINT) AS pii_columns,
        count(*) FILTER (overall_risk = 'critical') AS critical_pii_datasets,
        count(*) FILTER (overall_risk = 'high') AS high_pii_datasets, (SELECT count(*) FROM v WHERE NOT resolved) AS violations,
        (SELECT count(*) FROM e WHERE created_at >= {_EVENT_AS_OF} - INTERVAL 7 DAYS) AS audit_events_7d FROM d""",
    "gov_coverage": f"""{BASE} SELECT id, name, coalesce(overall_risk, 'unscanned') AS pii_risk,
        coalesce(pii_column_count, 0) AS pii_column_count, coalesce(critical_count, 0) AS critical_count FROM d""",
    "gov_policy_counts": f"{BASE}, {_V}, {_P}, {_STATUS} SELECT * EXCLUDE (status) FROM st",
    "gov_resolve": f"""{BASE}, {_V} SELECT policy_type, entity_id, resolved, '2001-08-02' AS resolved_day FROM v
        WHERE resolved""",
    "gov_inventory": f"""{BASE} SELECT id, name, row_count, column_count, size_bytes, status,
        coalesce(overall_risk, 'unscanned') AS pii_risk, pii_column_count AS pii_columns, critical_count AS critical_columns,
        latest_score AS quality_score, round(age, 1)::DOUBLE AS age_days, created_at FROM d""",
    "gov_findings": f"{BASE}, {_FINDINGS} SELECT * EXCLUDE (every) FROM fi",
    "gov_policy_status": f"""{BASE}, {_V}, {_P}, {_STATUS}, {_FIRST} SELECT st.*, coalesce(violations, '[]') AS violations
        FROM st LEFT JOIN f5 USING (policy_type)""",
    "gov_recommend": f"""{BASE}, {_V}, {_P}, {_STATUS}, {_FINDINGS}, lines AS (
        SELECT 0 AS k, 'Scan ' || count(*) || ' unscanned dataset(s) for PII exposure.' AS line, count(*) AS n FROM d
            WHERE scan_id IS NULL
        UNION ALL SELECT 1, 'Anonymize critical PII columns in: ' || string_agg(dataset_name, ', ' ORDER BY dataset_name) || '.',
            count(*) FROM (SELECT DISTINCT dataset_name FROM fi WHERE severity = 'critical' ORDER BY 1 LIMIT 3)
        UNION ALL SELECT 2, 'Resolve ' || count(*) || ' critical policy violation(s) immediately.', count(*) FROM st
            WHERE status = 'fail' AND severity = 'critical'
        UNION ALL SELECT 3, 'Review ' || count(*) || ' dataset(s) older than 1 year for retention compliance.', count(*) FROM d
            WHERE round(age, 1) > 365)
        SELECT row_number() OVER (ORDER BY k) - 1 AS place, line AS recommendation FROM lines WHERE n > 0""",
    "deadline_resolve": f"""WITH t AS ({w.REQUESTS.sql}), h AS (SELECT *, coalesce(status = 'pending'
        AND auto_approve_at <= {_EVENT_AS_OF}, false) AS due FROM t) SELECT id, CASE WHEN due THEN 'auto_approved' ELSE status END
        AS status, strftime(auto_approve_at, '%Y-%m-%d %H:%M:%S') AS auto_approve_at,
        CASE WHEN due THEN '{w.EVENTS_AS_OF}' END AS reviewed_at FROM h""",
    "stale_reset": f"""WITH t AS ({w.JOBS.sql}), h AS (SELECT *, created_at < {_EVENT_AS_OF} - INTERVAL 30 MINUTES AS late FROM t)
        SELECT id, kind, CASE WHEN late AND kind = 'al_session' AND status = 'training' THEN 'annotating'
        WHEN late AND kind <> 'al_session' AND status = 'running' THEN 'failed' ELSE status END AS status,
        CASE WHEN late AND kind <> 'al_session' AND status = 'running' THEN 'Interrupted by server restart' END AS error_message
        FROM h""",
}
