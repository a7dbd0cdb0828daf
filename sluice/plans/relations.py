"""Checks across tables, columns and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import cleaning, relations
from sluice.plans.tables import LINES, Derived, table

STRAY = Derived("orders", {"o_orderkey": "o_orderkey", "o_custkey": "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 14 = 0 THEN -o_custkey ELSE o_custkey END"})
GAPS = Derived(
    "events",
    {
        "event_id": "event_id",
        "user_id": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END",
        "ts": "ts",
        "value": "CASE WHEN event_id % 4 = 0 THEN value END",
        "event_type": "CASE WHEN event_id % 5 < 2 THEN event_type END",
    },
)
VOTES = Derived("orders", {"one": "o_orderpriority", "two": "CASE WHEN o_custkey % 4 = 0 THEN '1-URGENT' WHEN o_custkey % 11 = 0 THEN NULL ELSE o_orderpriority END"})
MEASURES = ("l_quantity", "l_extendedprice", "l_tax")
EDGES = (-1.0, 0.0, 1.0, 5.0)


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return relations.orphans(STRAY.frame(s, d), "o_custkey", table(s, d, "customer"), "c_custkey")


def _integrity(s: SparkSession, d: str) -> DataFrame:
    return relations.integrity(STRAY.frame(s, d), "o_custkey", table(s, d, "customer"), "c_custkey")


def _split(s: SparkSession, d: str) -> DataFrame:
    return relations.split(table(s, d, "orders").select("o_orderkey"), "o_orderkey", {"train": 7, "val": 2, "test": 1}, seed=5)


def _where(s: SparkSession, d: str) -> DataFrame:
    return relations.where_all(LINES.frame(s, d), [("l_quantity", ">=", 10), ("l_returnflag", "in", ("A", "N")), ("l_tax", "!=", 0.0)])


def _changes(s: SparkSession, d: str) -> DataFrame:
    whole = table(s, d, "customer").withColumn("c_mktsegment", F.expr("CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END"))
    before = whole.where("c_custkey % 19 <> 0")
    after = cleaning.lower_case(whole.where("c_custkey % 23 <> 0").withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("NONE"))), "c_name")
    return relations.changes(before, after, "c_custkey", "demo", "2024-01-01 00:00:00")


def _drift(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events")
    return relations.drift(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1").withColumn("value", F.col("value") * 2), "value", EDGES)


QUERIES = {
    "rel_orphans": _orphans,
    "rel_integrity": _integrity,
    "rel_correlations": lambda s, d: relations.correlations(LINES.frame(s, d), MEASURES),
    "rel_split": _split,
    "rel_where_all": _where,
    "rel_changes": _changes,
    "rel_kappa": lambda s, d: relations.kappa(VOTES.frame(s, d), "one", "two"),
    "rel_forward_fill": lambda s, d: relations.forward_fill(GAPS.frame(s, d), "user_id", ["ts", "event_id"], ["value", "event_type"]),
    "rel_drift": _drift,
}

_DRAW = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|5'), 1, 8)) AS BIGINT) / 4294967296.0"
_BIN = " + ".join(f"CAST(value >= {e} AS INTEGER)" for e in EDGES)
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM t"
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))
)

SQL = {
    "rel_orphans": f"WITH t AS ({STRAY.sql}) SELECT * FROM t WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "rel_integrity": f"""WITH t AS ({STRAY.sql}) SELECT count(*) AS rows, count(*) FILTER (o_custkey IS NULL) AS missing,
        count(*) FILTER (o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM t""",
    "rel_correlations": f"WITH t AS ({LINES.sql}) {_CORR}",
    "rel_split": f"""SELECT o_orderkey, CASE WHEN u < 7 / 10.0 THEN 'train' WHEN u < 7 / 10.0 + 2 / 10.0 THEN 'val' ELSE 'test' END AS part
        FROM (SELECT o_orderkey, {_DRAW} AS u FROM orders)""",
    "rel_where_all": f"WITH t AS ({LINES.sql}) SELECT * FROM t WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'N') AND l_tax <> 0",
    "rel_changes": """WITH c AS (SELECT * REPLACE (CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment) FROM customer),
        b AS (SELECT * FROM c WHERE c_custkey % 19 <> 0), a AS (SELECT * REPLACE (lower(c_name) AS c_name, coalesce(c_mktsegment, 'NONE') AS c_mktsegment) FROM c WHERE c_custkey % 23 <> 0),
        x AS (SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, unnest([{'k': 'c_name', 'o': b.c_name, 'n': a.c_name}, {'k': 'c_nationkey', 'o': b.c_nationkey::VARCHAR, 'n': a.c_nationkey::VARCHAR},
            {'k': 'c_acctbal', 'o': b.c_acctbal::VARCHAR, 'n': a.c_acctbal::VARCHAR}, {'k': 'c_mktsegment', 'o': b.c_mktsegment, 'n': a.c_mktsegment}]) AS u FROM b FULL JOIN a ON a.c_custkey = b.c_custkey)
        SELECT c_custkey, u.k AS "column", u.o AS old, u.n AS new, 'demo' AS method, TIMESTAMP '2024-01-01 00:00:00' AS changed_at FROM x WHERE u.o IS DISTINCT FROM u.n""",
    "rel_kappa": f"""WITH t AS (SELECT * FROM ({VOTES.sql}) WHERE one IS NOT NULL AND two IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n,
        count(*) FILTER (one = two)::DOUBLE AS same FROM t), e AS (SELECT sum(a * b)::DOUBLE AS c FROM (SELECT one AS k, count(*) AS a FROM t GROUP BY 1)
        JOIN (SELECT two AS k, count(*) AS b FROM t GROUP BY 1) USING (k))
        SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n, e""",
    "rel_forward_fill": f"""WITH t AS ({GAPS.sql}) SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER w AS value,
        last_value(event_type IGNORE NULLS) OVER w AS event_type FROM t
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "rel_drift": f"""WITH r AS (SELECT {_BIN} AS bin, count(*) AS n FROM events WHERE event_id % 2 = 0 AND value IS NOT NULL GROUP BY 1),
        c AS (SELECT {_BIN.replace("value", "(value * 2)")} AS bin, count(*) AS n FROM events WHERE event_id % 2 = 1 AND value IS NOT NULL GROUP BY 1),
        j AS (SELECT bin, greatest(coalesce(r.n / (SELECT sum(n) FROM r), 0), 1e-4) AS e, greatest(coalesce(c.n / (SELECT sum(n) FROM c), 0), 1e-4) AS a
        FROM r FULL JOIN c USING (bin)), p AS (SELECT *, (a - e) * ln(a / e) AS x FROM j)
        SELECT bin, round(e, 6) AS expected, round(a, 6) AS actual, round(x, 6) AS part, round((SELECT sum(x) FROM p), 6) AS psi FROM p""",
}
