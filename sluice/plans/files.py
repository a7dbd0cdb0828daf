"""Reading, describing and writing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.tables import LINES, scratch, table
from sluice.sources import files, sinks

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _csv(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").withColumn("o_day", F.to_date("o_orderdate")).drop("o_orderdate")
    path = sinks.save_output(days, scratch(spark, "orders") + ".csv", "csv")
    return files.read_file(spark, path).withColumn("o_day", F.date_format("o_day", "yyyy-MM-dd"))


def _csv_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with quotes, separators and line breaks, out and back."""
    path = sinks.save_output(table(spark, d, "documents"), scratch(spark, "documents") + ".csv", "csv")
    return files.read_file(spark, path)


def _csv_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a cell that does not fit: the cell is null, the line is kept."""
    odd = F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
    path = sinks.save_output(table(spark, d, "orders").select("o_orderkey", odd.alias("o_custkey"), "o_orderpriority"), scratch(spark, "rejects") + ".csv", "csv")
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_orderpriority string")
    read = files.read_csv(spark, path, schema, rejects="line")
    return read.where(F.col("line").isNotNull()).select("o_orderkey", "o_custkey", "o_orderpriority", "line")


def _ndjson(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.save_output(table(spark, d, "customer"), scratch(spark, "customer") + ".jsonl", "jsonl")
    return files.read_file(spark, path)


def _json_array(spark: SparkSession, d: str) -> DataFrame:
    """One array per file, each of at most 100,000 customers."""
    customers = table(spark, d, "customer").withColumn("chunk", F.floor(F.col("c_custkey") / 100_000))
    order = Window.partitionBy("chunk").orderBy("c_custkey")
    opening = F.when(F.row_number().over(order) == 1, F.lit("[\n")).otherwise(F.lit(","))
    closing = F.when(F.lead("c_custkey").over(order).isNull(), F.lit("\n]")).otherwise(F.lit(""))
    rows = F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    lines = customers.select("chunk", "c_custkey", F.concat(opening, rows, closing).alias("value"))
    path = scratch(spark, "customer") + ".json"
    (
        lines.repartition("chunk")
        .sortWithinPartitions("chunk", "c_custkey")
        .select("value", "chunk")
        .write.partitionBy("chunk")
        .text(path)
    )
    return files.read_file(spark, path).drop("chunk")


def _parquet(spark: SparkSession, d: str) -> DataFrame:
    lines = files.read_file(spark, f"{d}/lineitem.parquet")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Write a version, fix it, write the next one, read back the newest."""
    root = scratch(spark, "supplier")
    sinks.save_version(table(spark, d, "supplier"), root, "supplier.parquet")
    first = files.read_file(spark, sinks.latest_version(spark, root, "supplier.parquet"))
    sinks.save_version(first.withColumn("s_name", F.lower("s_name")), root, "supplier.parquet")
    return files.read_file(spark, sinks.latest_version(spark, root, "supplier.parquet"))


def _utf8(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "texts") + ".csv"
    table(spark, d, "documents").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    return files.invalid_utf8(spark, path).agg(
        F.sum("lines").alias("lines"), F.sum("invalid_lines").alias("invalid_lines")
    )


QUERIES = {
    "io_csv_roundtrip": _csv,
    "io_csv_documents": _csv_documents,
    "io_csv_rejects": _csv_rejects,
    "io_json_roundtrip": _ndjson,
    "io_json_array": _json_array,
    "io_parquet": _parquet,
    "io_preview": lambda s, d: files.preview(
        table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), ["p_partkey"]
    ),
    "io_head": lambda s, d: files.head(table(s, d, "documents"), 500, ["doc_id"]),
    "io_schema": lambda s, d: files.infer_schema(LINES.frame(s, d)),
    "io_versioned_write": _versions,
    "io_utf8": _utf8,
    "io_summary": lambda s, d: files.ingest_summary(table(s, d, "orders")).select("row_count", "column_count"),
}

SQL = {
    "io_csv_roundtrip": f"SELECT {ORDER_COLUMNS}, strftime(o_orderdate, '%Y-%m-%d') AS o_day FROM orders",
    "io_json_roundtrip": "SELECT * FROM customer",
    "io_csv_documents": "SELECT * FROM documents",
    "io_csv_rejects": """SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, o_orderpriority, o_orderkey || ',n/a,' || o_orderpriority AS line
        FROM orders WHERE o_orderkey % 13 = 0""",
    "io_json_array": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "io_parquet": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
        FROM lineitem GROUP BY ALL""",
    "io_preview": """SELECT '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand
            || '","p_type":"' || p_type || '","p_size":' || p_size || '}' AS sample_row,
            (SELECT count(*) FROM part) AS row_count, 5 AS column_count
        FROM part ORDER BY p_partkey LIMIT 3""",
    "io_head": "SELECT * FROM documents ORDER BY doc_id LIMIT 500",
    "io_schema": f"""WITH t AS ({LINES.sql})
        SELECT 0 AS ordinal, 'l_orderkey' AS name, 'integer' AS dtype, bool_or(l_orderkey IS NULL) AS nullable FROM t
        UNION ALL SELECT 1, 'l_linenumber', 'integer', bool_or(l_linenumber IS NULL) FROM t
        UNION ALL SELECT 2, 'l_quantity', 'float', bool_or(l_quantity IS NULL) FROM t
        UNION ALL SELECT 3, 'l_extendedprice', 'float', bool_or(l_extendedprice IS NULL) FROM t
        UNION ALL SELECT 4, 'l_tax', 'float', bool_or(l_tax IS NULL) FROM t
        UNION ALL SELECT 5, 'l_returnflag', 'string', bool_or(l_returnflag IS NULL) FROM t
        UNION ALL SELECT 6, 'l_suppkey', 'integer', bool_or(l_suppkey IS NULL) FROM t""",
    "io_versioned_write": "SELECT s_suppkey, lower(s_name) AS s_name, s_nationkey, s_acctbal FROM supplier",
    "io_utf8": "SELECT count(*) AS lines, 0 AS invalid_lines FROM documents",
    "io_summary": "SELECT count(*) AS row_count, 6 AS column_count FROM orders",
}
