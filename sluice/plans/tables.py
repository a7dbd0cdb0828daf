"""The given tables, and tables with planted defects derived from them.

Defects are written as expressions that read the same in Spark and in the
checking SQL, and are planted over the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the cluster's shared folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Derived:
    """A select list over one table, usable as a DataFrame and as SQL text."""

    def __init__(self, source: str, columns: dict[str, str], copies_where: str | None = None):
        self.source = source
        self.columns = columns
        self.copies_where = copies_where

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        base = table(spark, folder, self.source)
        picks = [f"{e} AS {c}" for c, e in self.columns.items()]
        out = base.selectExpr(*picks)
        if self.copies_where:
            out = out.unionByName(base.where(self.copies_where).selectExpr(*picks))
        return out

    @property
    def sql(self) -> str:
        picks = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        text = f"SELECT {picks} FROM {self.source}"
        if self.copies_where:
            text += f" UNION ALL SELECT {picks} FROM {self.source} WHERE {self.copies_where}"
        return text


# lineitem with missing prices and flags
LINES = Derived(
    "lineitem",
    {
        "l_orderkey": "l_orderkey",
        "l_linenumber": "l_linenumber",
        "l_quantity": "l_quantity",
        "l_extendedprice": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END",
        "l_tax": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_tax END",
        "l_returnflag": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END",
        "l_suppkey": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END",
    },
)

# orders with copies, missing values, mixed spellings, a rare class and a label column
ORDERS = Derived(
    "orders",
    {
        "order_id": "o_orderkey",
        "customer_id": "o_custkey",
        "total": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END",
        "priority": "CASE o_custkey % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN upper(o_orderpriority) "
        "ELSE concat(substr(o_orderpriority, 1, 3), lower(substr(o_orderpriority, 4))) END",
        "channel": "CASE WHEN o_orderkey % 25 = 0 THEN 'rare' ELSE 'common' END",
        "spread": "CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice * 50 ELSE o_totalprice END",
        "label": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'returned' "
        "ELSE o_orderstatus END",
    },
    copies_where="o_orderkey % 20 = 0",
)
