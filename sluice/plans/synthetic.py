"""Synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import synthetic
from sluice.plans.tables import Derived, scratch, table

OVERRIDES = {
    "value": {"min": 2.0, "max": 60.0, "null_rate": 0.2},
    "event_type": {"class_weights": {"view": 5, "click": 3, "error": 2}},
    "no_such_column": {"min": 1},
}
LINES = Derived(
    "lineitem",
    {
        "row_key": "l_orderkey * 10 + l_linenumber",
        "l_quantity": "l_quantity",
        "l_extendedprice": "l_extendedprice",
        "l_tax": "CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE l_tax END",
        "l_linenumber": "l_linenumber",
        "l_returnflag": "l_returnflag",
        "l_linestatus": "l_linestatus",
    },
)
MODELLED = ("l_quantity", "l_extendedprice", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus")


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "user_id", "event_type", "value")


def _resampled(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    return synthetic.bootstrap(df, int(df.count() * share), key, seed)


def _copula(s: SparkSession, d: str) -> DataFrame:
    """As many synthetic lines as there are lines, from a stored model."""
    lines = LINES.frame(s, d)
    root = scratch(s, "models")
    synthetic.fit_or_load(lines, root, "lineitem", columns=MODELLED)
    model = synthetic.fit_or_load(lines, root, "lineitem", columns=MODELLED)  # second use reads it back
    return synthetic.sample(model, lines.count())


def _fidelity(s: SparkSession, d: str) -> DataFrame:
    """Mean and spread of every numeric column, real and synthetic."""
    moments = lambda df, kind: df.select(
        F.lit(kind).alias("kind"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in MODELLED[:4]])),
    ).groupBy("kind", "column").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.count_if(F.col("v").isNull()) / F.count(F.lit(1))).alias("null_share")
    )
    return moments(LINES.frame(s, d), "real").unionByName(moments(_copula(s, d), "synthetic"))


QUERIES = {
    "syn_bootstrap": lambda s, d: _resampled(_events(s, d), "event_id", 0.75, 42),
    "syn_bootstrap_orders": lambda s, d: _resampled(
        table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1.5, 7
    ),
    "syn_copula": _copula,
    "syn_fidelity": _fidelity,
    "syn_clip": lambda s, d: synthetic.clip(_events(s, d), "value", 2.0, 60.0),
    "syn_class_weights": lambda s, d: synthetic.reweigh(_events(s, d), "event_type", {"a": 1, "b": 2, "c": 1}, "event_id"),
    "syn_null_rate": lambda s, d: synthetic.blank(_events(s, d), "value", 0.15, "event_id"),
    "syn_overrides": lambda s, d: synthetic.apply_overrides(_events(s, d), OVERRIDES, "event_id"),
}


def _u(seed: str) -> str:
    return f"(('0x' || substr(md5(event_id || '|{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def _bootstrap_sql(source: str, columns: str, key: str, share: float, seed: int) -> str:
    return f"""WITH r AS MATERIALIZED (SELECT {columns}, row_number() OVER (ORDER BY ('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT,
        {key}) - 1 AS place FROM {source}), p AS (SELECT ('0x' || substr(md5(i || '|{seed}'), 1, 15))::BIGINT
        % (SELECT count(*) FROM {source}) AS place FROM range((SELECT floor(count(*) * {share})::BIGINT FROM {source})) x(i)) SELECT {columns} FROM p JOIN r USING (place)"""


_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"
SQL = {
    "syn_bootstrap": _bootstrap_sql("events", "event_id, user_id, event_type, value", "event_id", 0.75, 42),
    "syn_bootstrap_orders": _bootstrap_sql("orders", "o_orderkey, o_orderstatus", "o_orderkey", 1.5, 7),
    "syn_clip": "SELECT event_id, user_id, event_type, greatest(2.0, least(value, 60.0)) AS value FROM events",
    "syn_class_weights": f"""SELECT event_id, user_id, CASE WHEN {_u('42|event_type|class')} < 0.25 THEN 'a'
        WHEN {_u('42|event_type|class')} < 0.75 THEN 'b' ELSE 'c' END AS event_type, value FROM events""",
    "syn_null_rate": f"""SELECT event_id, user_id, event_type, CASE WHEN {_u('42|value|null')} >= 0.15 THEN value END AS value
        FROM events""",
    "syn_overrides": f"""SELECT event_id, user_id, CASE WHEN {_u('42|event_type|class')} < 0.5 THEN 'view'
        WHEN {_u('42|event_type|class')} < 0.8 THEN 'click' ELSE 'error' END AS event_type,
        CASE WHEN {_u('42|value|null')} >= 0.2 THEN greatest(2.0, least(value, 60.0)) END AS value FROM events""",
}
