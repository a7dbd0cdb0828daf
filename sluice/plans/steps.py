"""Transformation steps and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.ranks import ordered_index
from sluice.operators import steps
from sluice.plans.tables import LINES, ORDERS, Derived, table

# sizes as text, some of them no numbers
SIZES = Derived(
    "part",
    {
        "p_partkey": "p_partkey",
        "size_text": "CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE cast(p_size AS STRING) END",
    },
)

OPERATORS = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}


def _step(kind: str, **config):
    return {"id": kind, "type": kind, "config": config}


def _on_lines(kind: str, **config):
    return lambda s, d: steps.run_step(LINES.frame(s, d), _step(kind, **config))


def _numeric_filter(operator: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        return steps.run_step(lines, _step("filter", column="l_quantity", operator=operator, value="25"))

    return run


def _text_filter(operator: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        customers = table(s, d, "customer").drop("c_acctbal")
        return steps.run_step(customers, _step("filter", column="c_mktsegment", operator=operator, value="BUILDING"))

    return run


def _sorted(descending: bool):
    """The order made visible: each row's position after the sort."""

    def run(s: SparkSession, d: str) -> DataFrame:
        lines = LINES.frame(s, d).select("l_orderkey", "l_linenumber", "l_tax")
        tax = F.col("l_tax")
        order = tax.desc_nulls_first() if descending else tax.asc_nulls_first()
        return ordered_index(lines, [order, "l_orderkey", "l_linenumber"], "place", start=1)

    return run


CHAIN = [
    _step("filter", column="total", operator="not_null"),
    _step("filter", column="total", operator=">", value="1000"),
    _step("deduplicate", columns=[]),
    _step("rename_column", **{"from": "priority", "to": "urgency"}),
    _step("drop_columns", columns=["channel", "spread", "no_such_column"]),
    _step("fill_nulls", column="label", strategy="drop_rows"),
    _step("lowercase", column="urgency"),
    _step("no_such_step"),
]
DRY = [
    _step("filter", column="priority", operator="contains", value="(?i)high|low"),
    _step("lowercase", column="priority"),
    _step("select_columns", columns=["order_id", "priority", "missing"]),
]
PREP = Derived(
    "orders",
    {
        "order_id": "o_orderkey",
        "total": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END",
        "priority": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END",
        "status": "o_orderstatus",
    },
)
SERIES = Derived(
    "events",
    {"event_id": "event_id", "ts": "ts", "value": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END"},
)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _sort_chain(s: SparkSession, d: str) -> DataFrame:
    prepared = steps.series_preparation(SERIES.frame(s, d), "ts", ["value"])
    return _rounded(prepared.drop("ts"), "value")


QUERIES = {
    "step_filter_not_null": _on_lines("filter", column="l_tax", operator="not_null"),
    "step_filter_is_null": _on_lines("filter", column="l_tax", operator="is_null"),
    "step_filter_contains": lambda s, d: steps.run_step(
        table(s, d, "part").drop("p_retailprice"), _step("filter", column="p_name", operator="contains", value="^s.*ring")
    ),
    **{f"step_filter_{name}": _numeric_filter(op) for name, op in OPERATORS.items()},
    "step_filter_uncastable": lambda s, d: steps.run_step(
        SIZES.frame(s, d), _step("filter", column="size_text", operator="<=", value=20)
    ),
    "step_filter_str_eq": _text_filter("=="),
    "step_filter_str_ne": _text_filter("!="),
    "step_filter_str_noop": _text_filter(">"),
    "step_select": _on_lines("select_columns", columns=["l_tax", "nothing", "l_orderkey"]),
    "step_drop": _on_lines("drop_columns", columns=["l_tax", "l_extendedprice", "nothing"]),
    "step_rename": _on_lines("rename_column", **{"from": "l_tax", "to": "tax"}),
    "step_fill_drop": _on_lines("fill_nulls", column="l_returnflag"),
    "step_fill_mean": lambda s, d: _rounded(_on_lines("fill_nulls", column="l_extendedprice", strategy="mean")(s, d), "l_extendedprice"),
    "step_fill_mean_int": lambda s, d: _rounded(_on_lines("fill_nulls", column="l_suppkey", strategy="mean")(s, d), "l_suppkey"),
    "step_fill_mode": _on_lines("fill_nulls", column="l_returnflag", strategy="mode"),
    "step_fill_value": _on_lines("fill_nulls", column="l_tax", strategy="value", value="-1"),
    "step_fill_value_text": _on_lines("fill_nulls", column="l_suppkey", strategy="value", value="none"),
    "step_dedup_all": lambda s, d: steps.run_step(ORDERS.frame(s, d), _step("deduplicate", columns=[])),
    "step_dedup_subset": lambda s, d: steps.run_step(
        ORDERS.frame(s, d), _step("deduplicate", columns=["customer_id", "label"], key="order_id")
    ),
    "step_lowercase": lambda s, d: steps.run_step(table(s, d, "part").drop("p_retailprice"), _step("lowercase", column="p_type")),
    "step_normalize": lambda s, d: _rounded(_on_lines("normalize", column="l_extendedprice")(s, d), "l_extendedprice"),
    "step_encode": _on_lines("encode_categorical", column="l_returnflag"),
    "step_encode_wide": lambda s, d: steps.run_step(
        table(s, d, "customer").select("c_custkey", F.reverse("c_name").alias("code")), _step("encode_categorical", column="code")
    ),
    "step_sort_asc": _sorted(False),
    "step_sort_desc": _sorted(True),
    "chain_trace": lambda s, d: steps.trace(ORDERS.frame(s, d), CHAIN),
    "chain_summary": lambda s, d: steps.run_summary(ORDERS.frame(s, d), CHAIN),
    "chain_previews": lambda s, d: steps.step_previews(PREP.frame(s, d).drop("total"), DRY[1:2], "order_id"),
    "chain_dry_run": lambda s, d: steps.dry_run(PREP.frame(s, d), DRY, ["order_id"]),
    "chain_clean": lambda s, d: _rounded(steps.starter_cleaning(ORDERS.frame(s, d)), "total", "spread"),
    "chain_features": lambda s, d: _rounded(
        steps.feature_preparation(PREP.frame(s, d), keep=["order_id"]), "total"
    ),
    "chain_orders": lambda s, d: steps.order_preparation(PREP.frame(s, d).drop("total"), ["order_id"]),
    "chain_series": _sort_chain,
}

_T = f"WITH t AS ({LINES.sql})"
_O = f"WITH t AS ({ORDERS.sql})"
_P = f"WITH t AS ({PREP.sql})"
_CHAIN = f"""WITH t0 AS ({ORDERS.sql}), t1 AS (SELECT * FROM t0 WHERE total IS NOT NULL),
    t2 AS (SELECT * FROM t1 WHERE total > 1000), t3 AS (SELECT DISTINCT * FROM t2),
    t4 AS (SELECT * FROM t3 WHERE label IS NOT NULL),
    n AS (SELECT (SELECT count(*) FROM t0) AS n0, (SELECT count(*) FROM t1) AS n1, (SELECT count(*) FROM t2) AS n2,
          (SELECT count(*) FROM t3) AS n3, (SELECT count(*) FROM t4) AS n4)"""

SQL = {
    "step_filter_not_null": f"{_T} SELECT * FROM t WHERE l_tax IS NOT NULL",
    "step_filter_is_null": f"{_T} SELECT * FROM t WHERE l_tax IS NULL",
    "step_filter_contains": """SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
        WHERE regexp_matches(p_name, '^s.*ring')""",
    **{
        f"step_filter_{name}": f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
            WHERE l_quantity {'=' if op == '==' else '<>' if op == '!=' else op} 25"""
        for name, op in OPERATORS.items()
    },
    "step_filter_uncastable": f"WITH t AS ({SIZES.sql}) SELECT * FROM t WHERE try_cast(size_text AS DOUBLE) <= 20",
    "step_filter_str_eq": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "step_filter_str_ne": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "step_filter_str_noop": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
    "step_select": f"{_T} SELECT l_tax, l_orderkey FROM t",
    "step_drop": f"{_T} SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_suppkey FROM t",
    "step_rename": f"{_T} SELECT * EXCLUDE (l_tax), l_tax AS tax FROM t",
    "step_fill_drop": f"{_T} SELECT * FROM t WHERE l_returnflag IS NOT NULL",
    "step_fill_mean": f"""{_T} SELECT * REPLACE (round(coalesce(l_extendedprice, (SELECT avg(l_extendedprice) FROM t)), 6)
        AS l_extendedprice) FROM t""",
    "step_fill_mean_int": f"""{_T} SELECT * REPLACE (round(coalesce(CAST(l_suppkey AS DOUBLE), (SELECT avg(l_suppkey) FROM t)), 6)
        AS l_suppkey) FROM t""",
    "step_fill_mode": f"""{_T} SELECT * REPLACE (coalesce(l_returnflag, (SELECT l_returnflag FROM t
        WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag) FROM t""",
    "step_fill_value": f"{_T} SELECT * REPLACE (coalesce(l_tax, -1.0) AS l_tax) FROM t",
    "step_fill_value_text": f"{_T} SELECT * REPLACE (coalesce(CAST(l_suppkey AS VARCHAR), 'none') AS l_suppkey) FROM t",
    "step_dedup_all": f"{_O} SELECT DISTINCT * FROM t",
    "step_dedup_subset": f"""{_O}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id, label ORDER BY order_id) AS rn
        FROM t) SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""",
    "step_lowercase": "SELECT p_partkey, p_name, p_brand, lower(p_type) AS p_type, p_size FROM part",
    "step_normalize": f"""{_T}, b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM t)
        SELECT t.* REPLACE (round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice) FROM t, b""",
    "step_encode": f"""{_T}, c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
        FROM (SELECT DISTINCT l_returnflag AS v FROM t WHERE l_returnflag IS NOT NULL))
        SELECT t.* REPLACE (CAST(code AS INTEGER) AS l_returnflag) FROM t LEFT JOIN c ON l_returnflag = v""",
    "step_encode_wide": """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY reverse(c_name)) - 1 AS INTEGER) AS code
        FROM customer""",
    "step_sort_asc": f"""{_T} SELECT l_orderkey, l_linenumber, l_tax, row_number() OVER
        (ORDER BY l_tax ASC NULLS FIRST, l_orderkey, l_linenumber) AS place FROM t""",
    "step_sort_desc": f"""{_T} SELECT l_orderkey, l_linenumber, l_tax, row_number() OVER
        (ORDER BY l_tax DESC NULLS FIRST, l_orderkey, l_linenumber) AS place FROM t""",
    "chain_trace": f"""{_CHAIN} SELECT * FROM (
        SELECT 0 AS step_no, 'filter' AS step_id, n0 AS rows_in, n1 AS rows_out, 7 AS cols_in, 7 AS cols_out FROM n
        UNION ALL SELECT 1, 'filter', n1, n2, 7, 7 FROM n UNION ALL SELECT 2, 'deduplicate', n2, n3, 7, 7 FROM n
        UNION ALL SELECT 3, 'rename_column', n3, n3, 7, 7 FROM n UNION ALL SELECT 4, 'drop_columns', n3, n3, 7, 5 FROM n
        UNION ALL SELECT 5, 'fill_nulls', n3, n4, 5, 5 FROM n UNION ALL SELECT 6, 'lowercase', n4, n4, 5, 5 FROM n
        UNION ALL SELECT 7, 'no_such_step', n4, n4, 5, 5 FROM n)""",
    "chain_summary": f"{_CHAIN} SELECT n0 AS rows_in, n4 AS rows_out, 7 AS cols_in, 5 AS cols_out FROM n",
    "chain_previews": f"""{_P} SELECT 0 AS step_no, '{{"order_id":' || order_id || ',"priority":' ||
        CASE WHEN priority IS NULL THEN 'null' ELSE '"' || lower(priority) || '"' END || ',"status":"' || status || '"}}' AS row
        FROM t ORDER BY order_id LIMIT 3""",
    "chain_dry_run": f"""{_P}, h AS (SELECT * FROM t ORDER BY order_id LIMIT 1000)
        SELECT order_id, lower(priority) AS priority FROM h WHERE regexp_matches(priority, '(?i)high|low')
        ORDER BY order_id LIMIT 10""",
    "chain_clean": f"""{_O}, u AS (SELECT DISTINCT * FROM t), m AS (SELECT avg(total) AS a FROM u)
        SELECT CAST(order_id AS DOUBLE) AS order_id, CAST(customer_id AS DOUBLE) AS customer_id,
        round(coalesce(total, a), 6) AS total, lower(priority) AS priority, lower(channel) AS channel,
        round(spread, 6) AS spread, lower(label) AS label FROM u, m""",
    "chain_features": f"""{_P}, m AS (SELECT avg(total) AS a, min(total) AS lo, max(total) AS hi FROM t),
        p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT priority AS v FROM t) WHERE v IS NOT NULL),
        q AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT status AS v FROM t) WHERE v IS NOT NULL)
        SELECT order_id, round((coalesce(total, a) - lo) / (hi - lo), 6) AS total, CAST(p.c AS INTEGER) AS priority,
        CAST(q.c AS INTEGER) AS status FROM t CROSS JOIN m LEFT JOIN p ON priority = p.v LEFT JOIN q ON status = q.v""",
    "chain_orders": f"""{_P}, f AS (SELECT order_id, status, coalesce(priority, (SELECT priority FROM t WHERE priority
        IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM t)
        SELECT order_id, CAST(dense_rank() OVER (ORDER BY status) - 1 AS INTEGER) AS status,
        CAST(dense_rank() OVER (ORDER BY priority) - 1 AS INTEGER) AS priority FROM f""",
    "chain_series": f"""WITH t AS ({SERIES.sql}), m AS (SELECT avg(value) AS a, min(value) AS lo, max(value) AS hi FROM t)
        SELECT event_id, round((coalesce(value, a) - lo) / (hi - lo), 6) AS value FROM t, m""",
}
