"""Repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import cleaning, quality
from sluice.plans.quality import _ISSUES, FACTS
from sluice.plans.tables import LINES, ORDERS, Derived, table

ISSUES = [
    {"issue_type": "null_values", "column_name": "total"},
    {"issue_type": "null_labels", "column_name": "label"},
    {"issue_type": "duplicate_rows", "column_name": None},
    {"issue_type": "mixed_case", "column_name": "priority"},
    {"issue_type": "high_skew", "column_name": "spread"},
]
CLASSES = Derived(
    "orders",
    {
        "order_id": "o_orderkey",
        "total": "o_totalprice",
        "label": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'rare' ELSE o_orderstatus END",
    },
)
FIXES = [
    {"issue_type": "duplicate_rows", "column_name": None},
    {"issue_type": "null_values", "column_name": "total"},
    {"issue_type": "mixed_case", "column_name": "priority"},
    {"issue_type": "outliers", "column_name": "spread"},
    {"issue_type": "null_labels", "column_name": "label"},
]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _undersampled(s: SparkSession, d: str) -> DataFrame:
    return cleaning.undersample(CLASSES.frame(s, d), "label", "order_id")


def _chain(s: SparkSession, d: str) -> DataFrame:
    fixed, _ = cleaning.apply_fixes(ORDERS.frame(s, d), FIXES, "order_id")
    return _rounded(fixed, "total", "spread")


def _log(s: SparkSession, d: str) -> DataFrame:
    return cleaning.apply_fixes(ORDERS.frame(s, d), FIXES, "order_id")[1]


def _resolved(s: SparkSession, d: str) -> DataFrame:
    orders = ORDERS.frame(s, d)
    found = quality.Scan(orders).issues()
    _, log = cleaning.apply_fixes(orders, FIXES, "order_id")
    return cleaning.mark_resolved(found, log).select("column_name", "issue_type", "dimension", "status")


QUERIES = {
    "fix_preview": lambda s, d: cleaning.preview(ORDERS.frame(s, d), ISSUES),
    "fix_null_mean": lambda s, d: _rounded(cleaning.fill_nulls(LINES.frame(s, d), "l_extendedprice"), "l_extendedprice"),
    "fix_null_mode": lambda s, d: cleaning.fill_nulls(ORDERS.frame(s, d), "label"),
    "fix_dedup": lambda s, d: cleaning.drop_duplicates(ORDERS.frame(s, d)),
    "fix_case": lambda s, d: cleaning.lower_case(ORDERS.frame(s, d), "priority"),
    "fix_winsorise": lambda s, d: _rounded(
        cleaning.winsorise(table(s, d, "events").select("event_id", "event_type", "value"), "value"), "value"
    ),
    "fix_winsorise_nulls": lambda s, d: _rounded(
        cleaning.winsorise(ORDERS.frame(s, d).withColumn("spread", F.when(F.col("total").isNotNull(), F.col("spread"))), "spread"),
        "spread",
    ),
    "fix_oversample": lambda s, d: cleaning.oversample(CLASSES.frame(s, d), "label", "order_id"),
    "fix_undersample": _undersampled,
    "fix_undersample_sizes": lambda s, d: _undersampled(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "fix_chain": _chain,
    "fix_log": _log,
    "fix_resolved": _resolved,
}

_O = f"WITH t AS MATERIALIZED ({ORDERS.sql})"
_C = f"WITH t AS MATERIALIZED ({CLASSES.sql})"
_DRAW = "('0x' || substr(md5(order_id || '|42'), 1, 8))::BIGINT"
_FENCE = """q AS (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM {t}),
    b AS (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM q)"""
_CHAIN = f"""{_O}, u AS MATERIALIZED (SELECT DISTINCT * FROM t), {_FENCE.format(c='spread', t='u')},
    m AS (SELECT avg(total) AS a FROM u),
    l AS (SELECT label AS v FROM u WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""

SQL = {
    "fix_preview": f"""{_O} SELECT 0 AS issue_no, 'null_values' AS issue_type, 'total' AS column_name,
        'mean_imputation' AS method, count(*) FILTER (total IS NULL) AS rows_affected FROM t
        UNION ALL SELECT 1, 'null_labels', 'label', 'mode_imputation', count(*) FILTER (label IS NULL) FROM t
        UNION ALL SELECT 2, 'duplicate_rows', NULL, 'drop_exact_duplicates',
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) FROM t
        UNION ALL SELECT 3, 'mixed_case', 'priority', 'lowercase_standardise',
            count(*) FILTER (lower(priority) <> priority AND upper(priority) <> priority) FROM t
        UNION ALL SELECT 4, 'high_skew', 'spread', 'no_op', 0""",
    "fix_null_mean": f"""WITH t AS ({LINES.sql}) SELECT * REPLACE (round(coalesce(l_extendedprice,
        (SELECT avg(l_extendedprice) FROM t)), 6) AS l_extendedprice) FROM t""",
    "fix_null_mode": f"""{_O} SELECT * REPLACE (coalesce(label, (SELECT label FROM t WHERE label IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS label) FROM t""",
    "fix_dedup": f"{_O} SELECT DISTINCT * FROM t",
    "fix_case": f"{_O} SELECT * REPLACE (lower(priority) AS priority) FROM t",
    "fix_winsorise": f"""WITH {_FENCE.format(c='value', t='events')} SELECT event_id, event_type,
        round(greatest(lo, least(value, hi)), 6) AS value FROM events, b""",
    "fix_winsorise_nulls": f"""WITH t AS ({ORDERS.sql}), n AS MATERIALIZED (SELECT * REPLACE (CASE WHEN total IS NOT NULL THEN spread END
        AS spread) FROM t), {_FENCE.format(c='spread', t='n')} SELECT n.* REPLACE (round(CASE WHEN spread IS NULL THEN NULL
        ELSE greatest(lo, least(spread, hi)) END, 6) AS spread) FROM n, b""",
    "fix_oversample": f"""{_C}, c AS (SELECT label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY 1),
        r AS (SELECT label, n FROM c ORDER BY n, label LIMIT 1), g AS (SELECT (SELECT max(n) FROM c) - n AS gap, n, label FROM r),
        ranked AS (SELECT t.*, row_number() OVER (ORDER BY {_DRAW}, order_id) - 1 AS place FROM t JOIN r ON t.label = r.label),
        picks AS (SELECT ('0x' || substr(md5(i || '|42'), 1, 15))::BIGINT % n AS place
            FROM g, range(0, (SELECT gap FROM g)::BIGINT) AS x(i))
        SELECT * FROM t UNION ALL SELECT order_id, total, label FROM picks JOIN ranked USING (place)""",
    "fix_undersample": f"""{_C}, c AS (SELECT label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY 1),
        top AS (SELECT label AS v FROM c ORDER BY n DESC, label DESC LIMIT 1), ranked AS (SELECT *, row_number() OVER
        (PARTITION BY label ORDER BY {_DRAW}, order_id) AS place FROM t WHERE label IS NOT NULL)
        SELECT order_id, total, label FROM ranked, top WHERE label <> v OR place <= (SELECT min(n) FROM c)""",
    "fix_undersample_sizes": f"""{_C}, c AS (SELECT label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY 1)
        SELECT label, CASE WHEN n = max(n) OVER () THEN min(n) OVER () ELSE n END AS n FROM c""",
    "fix_chain": f"""{_CHAIN} SELECT order_id, customer_id, round(coalesce(total, a), 6) AS total, lower(priority) AS priority,
        channel, round(greatest(lo, least(spread, hi)), 6) AS spread, coalesce(label, v) AS label FROM u, m, l, b""",
    "fix_log": f"""{_CHAIN} SELECT 0 AS fix_no, 'duplicate_rows' AS issue_type, NULL::VARCHAR AS column_name,
        (SELECT count(*) FROM t) - (SELECT count(*) FROM u) AS rows_changed
        UNION ALL SELECT 1, 'null_values', 'total', (SELECT count(*) FROM u WHERE total IS NULL)
        UNION ALL SELECT 2, 'mixed_case', 'priority', (SELECT count(*) FROM u WHERE priority <> lower(priority))
        UNION ALL SELECT 3, 'outliers', 'spread', (SELECT count(*) FROM u, b WHERE spread < lo OR spread > hi)
        UNION ALL SELECT 4, 'null_labels', 'label', (SELECT count(*) FROM u WHERE label IS NULL)""",
    "fix_resolved": f"""{FACTS}, {_ISSUES} SELECT column_name, issue_type, dimension, CASE WHEN (issue_type, coalesce(column_name, ''))
        IN (('duplicate_rows', ''), ('null_values', 'total'), ('mixed_case', 'priority'), ('outliers', 'spread'),
        ('null_labels', 'label')) THEN 'resolved' ELSE 'open' END AS status FROM i""",
}
