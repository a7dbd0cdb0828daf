"""Streams over the events: files arrive in slices, and the stream is stopped and started again after every slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.tables import Derived, scratch, table
from sluice.streaming import ingest, windows

SLICE_DAYS = 8
START = "TIMESTAMP '2024-01-01 00:00:00'"
LATE = "6 hours"
# every fifth event comes four hours late, every 45th ten days: those are older than the watermark
LAG = "CASE WHEN event_id % 45 = 0 THEN 240 WHEN event_id % 5 = 0 THEN 4 ELSE 0 END"
AGE = f"(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros({START})) / 3600000000.0"
SLICE = f"CAST(floor(({AGE} + {{lag}}) / {24 * SLICE_DAYS}) AS INT) AS slice"
VALUE = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN -value ELSE value END"
WATCHED = (windows.Watched("value", 0.0, 50.0), windows.Watched("event_type"))
TYPE = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END"


def _run(spark: SparkSession, arriving: DataFrame, label: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Let the rows of ``arriving`` come slice by slice (column ``slice``), with a run of the stream after each."""
    base = scratch(spark, label)
    schema = arriving.drop("slice").schema
    for number in sorted(r[0] for r in arriving.select("slice").distinct().collect()):
        arriving.where(F.col("slice") == number).drop("slice").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        windows.collected(transform(stream), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _arriving(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", f"{VALUE} AS value", f"{TYPE} AS event_type", SLICE.format(lag=LAG))


def _windows(s: SparkSession, d: str) -> DataFrame:
    return _run(s, _arriving(s, d), "stream-windows", lambda stream: windows.window_quality(stream, "ts", "1 day", LATE, WATCHED))


def _repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Every event once, every third again an hour later and every fourth two hours later; the last ones of a slice come with the next."""
    events = table(spark, folder, "events")

    def sent(hours: int, every: int) -> DataFrame:
        picks = "event_id", f"CAST(ts AS TIMESTAMP) + INTERVAL {hours} HOURS AS ts", "user_id", "event_type", "value", SLICE.format(lag=hours)
        return events.where(f"event_id % {every} = 0").selectExpr(*picks)

    return sent(0, 1).unionByName(sent(1, 3)).unionByName(sent(2, 4))


def _dedup(s: SparkSession, d: str) -> DataFrame:
    kept = _run(s, _repeated(s, d), "stream-dedup", lambda stream: windows.without_repeats(stream, ["event_id"], "ts", LATE))
    return kept.select("event_id", "user_id", "event_type", "value")


KINDS = ("click", "error", "purchase", "signup", "view")
FIELDS = (
    ingest.Field("event_id", "bigint", required=True),
    ingest.Field("ts", "timestamp", required=True),
    ingest.Field("user_id", "bigint", least=0),
    ingest.Field("event_type", "string", allowed=KINDS),
    ingest.Field("value", "double", least=0.0, most=1000.0),
)
LINES = Derived(
    "events",
    {
        "event_id": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR(20)) END",
        "ts": "CASE WHEN event_id % 23 = 0 THEN 'yesterday' ELSE concat('2024-01-', CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, CAST(event_id % 28 + 1 AS VARCHAR(20)), ' 10:20:30') END",
        "user_id": "CASE WHEN event_id % 19 = 0 THEN '-4' WHEN event_id % 37 = 0 THEN '12x' ELSE concat(' ', CAST(user_id AS VARCHAR(20)), ' ') END",
        "event_type": "CASE WHEN event_id % 29 = 0 THEN 'teleport' ELSE event_type END",
        "value": "CASE WHEN event_id % 17 = 0 THEN 'n/a' WHEN event_id % 41 = 0 THEN '5000' WHEN event_id % 6 = 0 THEN '' ELSE CAST(event_id % 500 AS VARCHAR(20)) END",
    },
)


def _taken(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = scratch(spark, "stream-ingest")
    good, bad = f"{base}/good", f"{base}/quarantine"
    for part in range(2):  # two deliveries, with a restart in between
        lines = LINES.frame(spark, folder).withColumn("part", F.pmod(F.xxhash64("user_id", "value"), F.lit(2)))
        lines.where(F.col("part") == part).drop("part").repartition(4).write.mode("append").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{base}/in")
        ingest.ingest(ingest.arrivals(spark, f"{base}/in", FIELDS, files_per_batch=3), FIELDS, good, bad, f"{base}/state").awaitTermination()
    return ingest.taken(spark, FIELDS, good, bad)


QUERIES = {
    "stream_windows": _windows,
    "stream_dedup": _dedup,
    "stream_ingest": lambda s, d: _taken(s, d)[0].drop("batch_id"),
    "stream_quarantine": lambda s, d: _taken(s, d)[1].groupBy("reasons").agg(F.count(F.lit(1)).alias("rows"), F.min("raw").alias("first_raw")),
}

_AGE = "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')"
_FACTS = ", ".join(
    f"""{{'column': '{w.name}', 'rows': count(*), 'nulls': count(*) - count({w.name}), 'invalid': {f"count(*) FILTER ({w.name} < {w.least} OR {w.name} > {w.most})" if w.least is not None else "0::BIGINT"},
    'mean': round(avg({x}), 4), 'least': min({x}), 'most': max({x})}}"""
    for w in WATCHED
    for x in [w.name if w.least is not None else f"TRY_CAST({w.name} AS DOUBLE)"]
)

_REASONS = """list_filter([
    CASE WHEN event_id IS NULL THEN 'event_id: missing' END,
    CASE WHEN ts = 'yesterday' THEN 'ts: not timestamp' END,
    CASE WHEN user_id = '12x' THEN 'user_id: not bigint' END, CASE WHEN user_id = '-4' THEN 'user_id: below 0' END,
    CASE WHEN event_type = 'teleport' THEN 'event_type: not allowed' END,
    CASE WHEN value = 'n/a' THEN 'value: not double' END, CASE WHEN value = '5000' THEN 'value: above 1000.0' END
  ], lambda x: x IS NOT NULL)"""

SQL = {
    "stream_windows": f"""
WITH e AS (
  SELECT ts, {VALUE} AS value, {TYPE} AS event_type, CAST(floor((({_AGE}) / 3600000000.0 + {LAG}) / {24 * SLICE_DAYS}) AS INT) AS slice FROM events
), marks AS (
  SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {LATE} AS mark,
    max(max(ts)) OVER () - INTERVAL {LATE} AS last FROM e GROUP BY slice
), w AS (
  SELECT e.*, time_bucket(INTERVAL 1 DAY, ts) AS window_start, last FROM e JOIN marks USING (slice)
  WHERE mark IS NULL OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > mark
), f AS (
  SELECT window_start, unnest([{_FACTS}]) AS x FROM w WHERE window_start + INTERVAL 1 DAY <= last GROUP BY window_start
)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, x."column" AS "column", x.rows AS rows, x.nulls AS nulls, x.invalid AS invalid,
  round(100 * (x.rows - x.nulls) / x.rows, 4) AS completeness, CASE WHEN x.rows > x.nulls THEN round(100 * (x.rows - x.nulls - x.invalid) / (x.rows - x.nulls), 4) END AS validity,
  x.mean AS mean, x.least AS least, x.most AS most FROM f""",
    "stream_dedup": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_ingest": f"""
WITH l AS ({LINES.sql}), r AS (SELECT *, {_REASONS} AS reasons FROM l)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(trim(user_id) AS BIGINT) AS user_id, event_type, TRY_CAST(value AS DOUBLE) AS value FROM r WHERE len(reasons) = 0""",
    "stream_quarantine": f"""
WITH l AS ({LINES.sql}), r AS (SELECT *, {_REASONS} AS reasons FROM l)
SELECT array_to_string(reasons, '; ') AS reasons, count(*) AS rows,
  min(CAST(json_object('event_id', event_id, 'ts', ts, 'user_id', user_id, 'event_type', event_type, 'value', nullif(value, '')) AS VARCHAR)) AS first_raw
FROM r WHERE len(reasons) > 0 GROUP BY 1""",
}
