"""Quality scan: facts, issues, scores, profiles and scan history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import profile, quality
from sluice.plans.tables import ORDERS, Derived, table

# every scan of every customer's dataset
HISTORY = Derived(
    "orders",
    {
        "scan_id": "o_orderkey",
        "dataset_id": "o_custkey",
        "created_at": "o_orderdate",
        "status": "CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'complete' END",
        "score": "CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 10",
    },
)


def _orders_facts(*parts: str):
    return lambda s, d: profile.facts(ORDERS.frame(s, d), parts)


_ISSUE_KEYS = ("place", *quality.ISSUE_COLUMNS)


def _top_values(s: SparkSession, d: str) -> DataFrame:
    """Top values of the order and document texts, with their share of the non-null values."""
    orders = ORDERS.frame(s, d)
    documents = table(s, d, "documents").select("text", "lang", "source")
    parts = []
    for name, df in (("orders", orders), ("documents", documents)):
        counts = profile.value_counts(df)
        whole = counts.groupBy(F.col("column").alias("c")).agg(F.sum("n").alias("whole"))
        top = profile.top_values(counts)
        parts.append(
            top.join(F.broadcast(whole), F.col("column") == F.col("c")).select(  # one row per column
                F.lit(name).alias("table_name"), "column", "place", "value", "n",
                F.round(F.col("n") / F.col("whole") * 100, 1).alias("pct"),
            )
        )
    return parts[0].unionByName(parts[1])


def _outliers(source: str, *columns: str):
    return lambda s, d: quality.outliers(profile.facts(table(s, d, source).select(*columns), ("outliers",)))


def _profile(s: SparkSession, d: str) -> DataFrame:
    """Profiles, with the statistics as columns and the issues as one text."""
    profiles = quality.Scan(ORDERS.frame(s, d)).profiles()
    numbers = {f"stat_{n}": F.get_json_object("stats", f"$.{n}").cast("double") for n in ("min", "max", "mean", "median", "std")}
    texts = {"stat_unique": F.get_json_object("stats", "$.unique").cast("bigint"), "stat_most_common": F.get_json_object("stats", "$.most_common")}
    found = F.from_json("issues", "array<struct<issue_type: string, severity: string, affected_count: bigint, impact_score: double>>")
    told = F.transform(found, lambda i: F.concat_ws("|", i["issue_type"], i["severity"], i["affected_count"].cast("string"), F.round(i["impact_score"] * 100).cast("bigint").cast("string")))
    return profiles.withColumns({**numbers, **texts, "issues": F.array_join(told, ";")}).drop("stats")


QUERIES = {
    "q_null_census": lambda s, d: quality.null_census(_orders_facts("nulls")(s, d)),
    "q_completeness": lambda s, d: quality.completeness(_orders_facts("nulls")(s, d)),
    "q_duplicates": lambda s, d: profile.duplicates(ORDERS.frame(s, d)),
    "q_mixed_case": lambda s, d: quality.mixed_case(_orders_facts("case")(s, d)),
    "q_mixed_case_parts": lambda s, d: quality.mixed_case(profile.facts(table(s, d, "part"), ("case",))),
    "q_consistency": lambda s, d: quality.consistency(
        _orders_facts("case")(s, d), profile.duplicates(ORDERS.frame(s, d))
    ),
    "q_outliers": lambda s, d: quality.outliers(_orders_facts("outliers")(s, d)),
    "q_outliers_events": _outliers("events", "value"),
    "q_outliers_documents": _outliers("documents", "n_chars"),
    "q_accuracy": lambda s, d: quality.accuracy(_orders_facts("outliers")(s, d)),
    "q_skew": lambda s, d: quality.skewness(_orders_facts("moments")(s, d)),
    "q_skew_documents": lambda s, d: quality.skewness(
        profile.facts(table(s, d, "documents").select("n_chars"), ("moments",))
    ),
    "q_imbalance": lambda s, d: quality.imbalance(_orders_facts("values")(s, d)),
    "q_distribution": lambda s, d: quality.distribution(_orders_facts("moments", "values")(s, d)),
    "q_label_nulls": lambda s, d: quality.label_nulls(_orders_facts("nulls")(s, d)),
    "q_label_imbalance": lambda s, d: quality.label_imbalance(_orders_facts("values")(s, d)),
    "q_label_score": lambda s, d: quality.label_quality(_orders_facts("values")(s, d)),
    "q_overall": lambda s, d: quality.Scan(ORDERS.frame(s, d)).scores(),
    "q_issue_rank": lambda s, d: quality.Scan(ORDERS.frame(s, d)).issues().select(*_ISSUE_KEYS),
    "q_profile_numeric": lambda s, d: quality.numeric_profile(_orders_facts("moments")(s, d)),
    "q_profile_string": lambda s, d: quality.string_profile(_orders_facts("values")(s, d)),
    "q_top_values": _top_values,
    "q_column_score": lambda s, d: (lambda scan: quality.column_scores(scan.facts, scan.issues()))(
        quality.Scan(ORDERS.frame(s, d))
    ),
    "q_profile": _profile,
    "q_latest_scan": lambda s, d: quality.latest_scans(HISTORY.frame(s, d).select(
        "dataset_id", "created_at", "scan_id", "status", "score")).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd")),
    "q_score_delta": lambda s, d: quality.score_deltas(HISTORY.frame(s, d), order=["scan_id"]).withColumn(
        "delta", F.round("delta", 4)),
}

# --- the same in SQL ----------------------------------------------------------

NUMBERS = ("order_id", "customer_id", "total", "spread")
TEXTS = ("priority", "channel", "label")
COLUMNS = ("order_id", "customer_id", "total", "priority", "channel", "spread", "label")


def _fact_rows() -> str:
    rows = []
    for i, c in enumerate(COLUMNS):
        text = c in TEXTS
        numeric = (
            f"min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, avg({c}) AS mean, stddev_pop({c}) AS std, "
            f"(SELECT avg(power(({c} - m) / s, 3)) FROM t, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM t)) AS skew, "
            f"quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.5)::DOUBLE AS median, "
            f"quantile_cont({c}, 0.75)::DOUBLE AS q3, "
            f"(SELECT count(*) FROM t, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM t) "
            f"WHERE {c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) AS outs, "
            "NULL::BIGINT AS distinct_n, NULL::BIGINT AS top_n, NULL::BIGINT AS bottom_n, NULL AS top_value"
        )
        strings = (
            "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, "
            f"NULL::BIGINT, count(DISTINCT {c}), "
            f"(SELECT max(n) FROM (SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})), "
            f"(SELECT min(n) FROM (SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})), "
            f"(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        )
        rows.append(
            f"SELECT {i} AS ordinal, '{c}' AS col, '{'string' if text else 'numeric'}' AS kind, "
            f"{'true' if c == 'label' else 'false'} AS is_label, count(*) AS n, count(*) - count({c}) AS nulls, "
            f"{f'count(*) FILTER ({c} = lower({c}))' if text else 'NULL'}::BIGINT AS lower_n, "
            f"{f'count(*) FILTER ({c} = upper({c}))' if text else 'NULL'}::BIGINT AS upper_n, "
            f"{strings if text else numeric} FROM t"
        )
    return " UNION ALL ".join(rows)


_SEV = "CASE WHEN {p} >= 15 THEN 'critical' WHEN {p} >= 5 THEN 'warning' ELSE 'info' END"
FACTS = f"""WITH t AS MATERIALIZED ({ORDERS.sql}), f0 AS ({_fact_rows()}),
    f AS MATERIALIZED (SELECT *, nulls * 100.0 / n AS null_pct, n - nulls AS present, n - nulls - lower_n - upper_n AS mixed,
        outs * 100.0 / n AS out_pct, top_n / greatest(bottom_n, 1) AS ratio FROM f0),
    dup AS MATERIALIZED (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM t)
        - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS copies),
    g AS (SELECT *, coalesce(kind = 'string' AND present >= 10 AND mixed > 0 AND mixed / present > 0.05, false) AS is_mixed,
        coalesce(kind = 'numeric' AND present >= 20 AND std > 0 AND abs(skew) > 2, false) AS is_skewed,
        coalesce(kind = 'string' AND present >= 10 AND distinct_n > 1 AND top_n * 100.0 / present > 90, false) AS is_dominated,
        coalesce(kind = 'string' AND distinct_n > 1 AND ratio > 10, false) AS is_lopsided FROM f)"""
_ISSUES = f"""i AS (
    SELECT col AS column_name, 'null_values' AS issue_type, 'completeness' AS dimension, {_SEV.format(p='null_pct')} AS severity,
        nulls AS affected_count, null_pct AS pct, least(null_pct * 0.8, 20) AS impact, 'auto' AS fix FROM g WHERE nulls > 0
    UNION ALL SELECT NULL, 'duplicate_rows', 'consistency', {_SEV.format(p='copies * 100.0 / n')}, copies,
        copies * 100.0 / n, least(copies * 50.0 / n, 10), 'auto' FROM dup WHERE copies > 0
    UNION ALL SELECT col, 'mixed_case', 'consistency', 'info', mixed, mixed * 100.0 / present, 1, 'auto' FROM g WHERE is_mixed
    UNION ALL SELECT col, 'outliers', 'accuracy', {_SEV.format(p='out_pct')}, outs, out_pct, least(out_pct * 0.7, 10),
        'semi_auto' FROM g WHERE outs > 0
    UNION ALL SELECT col, 'high_skew', 'distribution', 'info', present, 100, 2, NULL FROM g WHERE is_skewed
    UNION ALL SELECT col, 'class_imbalance', 'distribution', 'warning', n, 100, 8, NULL FROM g WHERE is_dominated
    UNION ALL SELECT col, 'null_labels', 'label_quality', CASE WHEN null_pct > 5 THEN 'critical' ELSE 'warning' END, nulls,
        null_pct, least(null_pct * 1.2, 20), 'semi_auto' FROM g WHERE is_label AND nulls > 0
    UNION ALL SELECT col, 'class_imbalance', 'label_quality', 'warning', n, 100, least(ratio * 0.3, 15), NULL
        FROM g WHERE is_label AND is_lopsided)"""
_NAME = "chr(39) || col || chr(39)"
_DESCRIPTION = f"""CASE issue_type || ' ' || dimension
    WHEN 'null_values completeness' THEN printf('%.1f%% null values in %s', pct, {_NAME})
    WHEN 'duplicate_rows consistency' THEN format('{{:,}} exact duplicate rows ({{:.1f}}%)', affected_count, pct)
    WHEN 'mixed_case consistency' THEN printf('Mixed case values in %s (%.1f%% inconsistent)', {_NAME}, pct)
    WHEN 'outliers accuracy' THEN format('{{:,}} outliers in {{}} ({{:.1f}}%), beyond the 3x IQR fence', affected_count, {_NAME}, pct)
    WHEN 'high_skew distribution' THEN printf('High skewness (%.2f) in %s, consider a log transform', skew, {_NAME})
    WHEN 'class_imbalance distribution' THEN printf('Severe class imbalance in %s, dominant class %.1f%% (ratio %.0f:1)', {_NAME}, top_n * 100.0 / present, ratio)
    WHEN 'null_labels label_quality' THEN printf('%.1f%% null values in label column %s', pct, {_NAME})
    WHEN 'class_imbalance label_quality' THEN printf('Label imbalance in %s, %.0f:1 ratio between classes', {_NAME}, ratio) END"""
_SCORES = """s AS (SELECT
    (SELECT round(avg(greatest(0, 100 - null_pct * 1.5)), 1) FROM g) AS completeness,
    (SELECT round(greatest(0, 100 - copies * 200.0 / n - 2 * (SELECT count(*) FROM g WHERE is_mixed)), 1) FROM dup) AS consistency,
    (SELECT round(greatest(0, 100 - avg(CASE WHEN outs > 0 THEN least(out_pct * 1.2, 15) ELSE 0 END)), 1) FROM g) AS accuracy,
    (SELECT round(greatest(0, 100 - coalesce(avg(CASE WHEN is_skewed THEN 5 WHEN is_dominated THEN 8 END), 0)), 1) FROM g)
        AS distribution,
    (SELECT round(greatest(0, 100 - coalesce(avg(p), 0)), 1) FROM (
        SELECT least(null_pct * 2, 30) AS p FROM g WHERE is_label AND nulls > 0
        UNION ALL SELECT 10 FROM g WHERE is_label AND is_lopsided)) AS label_quality)"""
_COLUMN_SCORES = """cs AS (SELECT g.*, round(greatest(0, 100 - null_pct * 1.5 - coalesce((SELECT sum(CASE severity
    WHEN 'critical' THEN 15 WHEN 'warning' THEN 8 ELSE 3 END) FROM i WHERE column_name = g.col), 0)), 1) AS quality_score FROM g)"""


def _tops(source: str, name: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{name}' AS table_name, '{c}' AS "column",
        row_number() OVER (ORDER BY count(*) DESC, {c}) AS place, {c} AS "value", count(*) AS n,
        round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})
        WHERE place <= 10"""
        for c in columns
    )


def _fence_sql(source: str, c: str) -> str:
    return f"""WITH q AS (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3,
        count(*) AS n FROM {source}), o AS (SELECT count(*) AS outs FROM {source}, q
        WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))
        SELECT '{c}' AS "column", n AS numbers, round(q1, 6) AS q1, round(q3, 6) AS q3, outs AS outliers,
        round(outs * 100.0 / n, 3) AS outlier_pct, {_SEV.format(p='outs * 100.0 / n')} AS severity FROM q, o"""


_PART_CASE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) FILTER (lower({c}) = {c}) AS lower_n,
    count(*) FILTER (upper({c}) = {c}) AS upper_n FROM part"""
    for c in ("p_name", "p_brand", "p_type")
)

SQL = {
    "q_null_census": f"""{FACTS} SELECT col AS "column", nulls AS null_count, round(null_pct, 3) AS null_pct,
        {_SEV.format(p='null_pct')} AS severity, round(least(null_pct * 0.8, 20), 2) AS impact_score FROM g""",
    "q_completeness": f"{FACTS}, {_SCORES} SELECT completeness FROM s",
    "q_duplicates": f'{FACTS} SELECT n AS "rows", copies FROM dup',
    "q_mixed_case": f"""{FACTS} SELECT col AS "column", present AS non_null, lower_n, upper_n, mixed AS mixed_n,
        is_mixed AS flagged FROM g WHERE kind = 'string'""",
    "q_mixed_case_parts": f"""SELECT *, non_null - lower_n - upper_n AS mixed_n, non_null >= 10 AND
        non_null - lower_n - upper_n > 0.05 * non_null AS flagged FROM ({_PART_CASE})""",
    "q_consistency": f"{FACTS}, {_SCORES} SELECT consistency FROM s",
    "q_outliers": f"""{FACTS} SELECT col AS "column", present AS numbers, round(q1, 6) AS q1, round(q3, 6) AS q3,
        outs AS outliers, round(out_pct, 3) AS outlier_pct, {_SEV.format(p='out_pct')} AS severity
        FROM g WHERE kind = 'numeric'""",
    "q_outliers_events": _fence_sql("events", "value"),
    "q_outliers_documents": _fence_sql("documents", "n_chars"),
    "q_accuracy": f"{FACTS}, {_SCORES} SELECT accuracy FROM s",
    "q_skew": f"""{FACTS} SELECT col AS "column", present AS numbers, round(skew, 4) AS skew, is_skewed AS flagged
        FROM g WHERE kind = 'numeric'""",
    "q_skew_documents": """WITH m AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)
        SELECT 'n_chars' AS "column", count(*) AS numbers, round(avg(power((n_chars - m) / s, 3)), 4) AS skew,
        abs(avg(power((n_chars - m) / s, 3))) > 2 AS flagged FROM documents, m""",
    "q_imbalance": f"""{FACTS} SELECT col AS "column", top_n, bottom_n, round(top_n * 100.0 / present, 4) AS top_pct,
        round(ratio, 4) AS ratio FROM g WHERE is_dominated""",
    "q_distribution": f"{FACTS}, {_SCORES} SELECT distribution FROM s",
    "q_label_nulls": f"""{FACTS} SELECT col AS "column", nulls AS null_count, round(null_pct, 3) AS null_pct,
        CASE WHEN null_pct > 5 THEN 'critical' ELSE 'warning' END AS severity, round(least(null_pct * 2, 30), 4) AS penalty,
        round(least(null_pct * 1.2, 20), 2) AS impact_score FROM g WHERE is_label""",
    "q_label_imbalance": f"""{FACTS} SELECT col AS "column", distinct_n AS classes, top_n, bottom_n, round(ratio, 4) AS ratio,
        is_lopsided AS flagged FROM g WHERE is_label""",
    "q_label_score": f"{FACTS}, {_SCORES} SELECT label_quality FROM s",
    "q_overall": f"""{FACTS}, {_SCORES} SELECT round(completeness * 0.25 + consistency * 0.2 + accuracy * 0.25
        + distribution * 0.2 + label_quality * 0.1, 1) AS overall, * FROM s""",
    "q_issue_rank": f"""{FACTS}, {_ISSUES} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0
        WHEN 'warning' THEN 1 ELSE 2 END, round(impact, 2) DESC, column_name NULLS FIRST, issue_type, dimension) AS place,
        column_name, issue_type, dimension, severity, affected_count, round(pct, 3)::DOUBLE AS affected_pct,
        round(impact, 2)::DOUBLE AS impact_score, fix IS NOT NULL AS fix_available, fix AS fix_type, 'open' AS status,
        substr(md5(concat_ws('|', column_name, issue_type, dimension)), 1, 16) AS id, {_DESCRIPTION} AS description FROM i LEFT JOIN g ON g.col = column_name""",
    "q_profile_numeric": f"""{FACTS} SELECT col AS "column", round(lo, 4) AS "min", round(hi, 4) AS "max",
        round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std FROM g WHERE kind = 'numeric'""",
    "q_profile_string": f"""{FACTS} SELECT col AS "column", distinct_n AS "unique", top_value AS most_common,
        distinct_n + (nulls > 0)::BIGINT AS unique_count FROM g WHERE kind = 'string'""",
    "q_top_values": f"""WITH t AS MATERIALIZED ({ORDERS.sql}) {_tops('t', 'orders', TEXTS)}
        UNION ALL {_tops('documents', 'documents', ('text', 'lang', 'source'))}""",
    "q_column_score": f'{FACTS}, {_ISSUES}, {_COLUMN_SCORES} SELECT col AS "column", quality_score FROM cs',
    "q_profile": f"""{FACTS}, {_ISSUES}, {_COLUMN_SCORES}, tops AS ({_tops('t', 'orders', TEXTS)})
        SELECT ordinal, col AS name, CASE WHEN kind = 'string' THEN 'string' WHEN col IN ('total', 'spread') THEN 'float'
        ELSE 'integer' END AS dtype, nulls AS null_count, round(null_pct, 3) AS null_pct,
        distinct_n + (nulls > 0)::BIGINT AS unique_count, quality_score,
        coalesce((SELECT '[' || string_agg('{{"label":"' || "value" || '","count":' || tops.n || ',"pct":' || pct || '}}', ','
            ORDER BY place) || ']' FROM tops WHERE "column" = cs.col), '[]') AS distribution,
        round(lo, 4) AS stat_min, round(hi, 4) AS stat_max, round(mean, 4) AS stat_mean, round(median, 4) AS stat_median, round(std, 4) AS stat_std,
        distinct_n AS stat_unique, top_value AS stat_most_common, coalesce((SELECT string_agg(concat_ws('|', issue_type, severity, affected_count,
            CAST(round(round(impact, 2) * 100) AS BIGINT)), ';' ORDER BY issue_type, severity, affected_count, impact) FROM i WHERE column_name = cs.col), '') AS issues FROM cs""",
    "q_latest_scan": f"""WITH h AS ({HISTORY.sql}), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id
        ORDER BY created_at DESC, scan_id DESC) AS place FROM h) SELECT dataset_id, strftime(created_at, '%Y-%m-%d')
        AS created_at, scan_id, status, score FROM r WHERE place = 1""",
    "q_score_delta": f"""WITH h AS ({HISTORY.sql}), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id
        ORDER BY created_at DESC, scan_id DESC) AS place, lead(score) OVER (PARTITION BY dataset_id
        ORDER BY created_at DESC, scan_id DESC) AS previous FROM h WHERE status = 'complete')
        SELECT dataset_id, score AS latest, previous, round(score - previous, 4) AS delta FROM r WHERE place = 1""",
}
