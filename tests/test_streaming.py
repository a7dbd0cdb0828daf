"""Streams: late rows, restarts and batches that are run again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.streaming import ingest, windows

DAY = dt.datetime(2024, 5, 1)
SCHEMA = "id bigint, ts timestamp, value double"


def at(hours):
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture
def feed(spark, tmp_path):
    """Let rows arrive in a file, run the stream over it, and read what has come out so far."""

    def arrive(rows, transform):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        windows.collected(transform(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    return arrive


def test_late_rows_within_the_delay_count_and_later_ones_do_not(feed):
    quality = lambda s: windows.window_quality(s, "ts", "1 hour", "2 hours", [windows.Watched("value", 0, 10)])
    feed([(1, at(0.1), 1.0), (2, at(0.5), None), (3, at(1.5), 99.0)], quality)
    feed([(4, at(0.9), 5.0), (5, at(9), 2.0), (6, None, 3.0)], quality)  # 4 is late but in time: the watermark stands at -0.5 hours
    out = feed([(7, at(0.2), 7.0), (8, at(20), 1.0)], quality)  # 7 comes when the watermark stands at 7 hours
    got = {r["window_start"]: (r["rows"], r["nulls"], r["invalid"], r["completeness"], r["validity"], r["mean"], r["least"], r["most"]) for r in out.collect()}
    assert got == {
        at(0): (3, 1, 0, 66.6667, 100.0, 3.0, 1.0, 5.0),
        at(1): (1, 0, 1, 100.0, 0.0, 99.0, 99.0, 99.0),
        at(9): (1, 0, 0, 100.0, 100.0, 2.0, 2.0, 2.0),
    }


def test_repeats_are_dropped_across_restarts_until_their_state_expires(feed):
    once = lambda s: windows.without_repeats(s, ["id"], "ts", "2 hours")
    feed([(1, at(0), 1.0), (1, at(1), 1.0), (2, at(3), 2.0)], once)
    out = feed([(2, at(4), 2.0), (3, at(12), 3.0)], once)  # 2 is known from the run before
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]
    out = feed([(2, at(13), 2.0)], once)  # ten hours later it is a new event
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 2, 3]


FIELDS = (ingest.Field("id", "bigint", required=True), ingest.Field("when", "date"), ingest.Field("size", "double", least=0), ingest.Field("kind", "string", allowed=("a", "b")))


def test_good_rows_and_quarantine_add_up_and_a_replayed_batch_adds_nothing(spark, tmp_path):
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("id,when,size,kind\n1,2024-01-02,3.5,a\nx,2024-01-02,1,a\n,2024-13-02,-1,c\n4,,,\n")
    run = lambda: ingest.ingest(ingest.arrivals(spark, f"{tmp_path}/in", FIELDS), FIELDS, good, bad, f"{tmp_path}/state").awaitTermination()
    run()
    (tmp_path / "in/2.csv").write_text("id,when,size,kind\n5,2024-01-03,0,b\n6,2024-01-04,1,a,too,many\n")
    run()
    kept, held = ingest.taken(spark, FIELDS, good, bad)
    rows = {(r["id"], str(r["when"]), r["size"], r["kind"]) for r in kept.collect()}
    assert rows == {(1, "2024-01-02", 3.5, "a"), (4, "None", None, None), (5, "2024-01-03", 0.0, "b")}
    reasons = sorted(r["reasons"] for r in held.collect())
    assert reasons == ["id: missing; when: not date; size: below 0; kind: not allowed", "id: not bigint", "line: broken"]
    again = spark.createDataFrame([("5", "2024-01-03", "0", "b", None), ("6", "2024-01-04", "1", "a", "6,2024-01-04,1,a,too,many")], f"id string, when string, size string, kind string, {ingest.CORRUPT} string")
    ingest.write_batch(again, 1, FIELDS, good, bad)  # the second batch, once more
    kept, held = ingest.taken(spark, FIELDS, good, bad)
    assert kept.count() == 3 and held.count() == 3
    assert held.where("reasons = 'line: broken'").select(F.col("raw")).first()[0] == "6,2024-01-04,1,a,too,many"
