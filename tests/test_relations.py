import pytest

from sluice.operators import relations


def test_forward_fill_over_partitions(spark):
    """One group holds most rows and spans many partitions; values may be carried over several."""
    rows = [(i, "hot" if i > 40 else f"g{i // 10}", i, i if i in (42, 60, 170) or i % 10 == 3 and i < 40 else None) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 1, 5), (901, None, 2, None)], "id int, g string, t int, v int").repartition(13)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["id"]: r["v"] for r in relations.forward_fill(df, "g", ["t", "id"], ["v"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, want = {}, {900: 5, 901: 5}
    for i, g, _, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[i] = last[g]
    assert got == want


def test_split_takes_all_rows_and_where_all_no_nulls(spark):
    df = spark.range(2_000)
    parts = {r["part"]: r["count"] for r in relations.split(df, "id", {"a": 3, "b": 1}).groupBy("part").count().collect()}
    assert sum(parts.values()) == 2_000 and parts["a"] == pytest.approx(1_500, rel=0.1)
    odd = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, x int")
    assert [r["id"] for r in relations.where_all(odd, [("x", "!=", 7), ("id", ">", 0)]).collect()] == [2]
    assert relations.where_all(odd, []).count() == 3


def test_kappa_and_changes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("a", None)], "x string, y string")
    row = relations.kappa(df, "x", "y").first()
    assert (row["n"], row["agreement"], row["kappa"]) == (4, 0.75, 0.5)
    before = spark.createDataFrame([(1, "x", None), (2, "y", 3)], "k int, s string, n int")
    after = spark.createDataFrame([(1, "x", 4), (2, "z", 3)], "k int, s string, n int")
    got = {(r["k"], r["column"], r["old"], r["new"]) for r in relations.changes(before, after, "k", "m", "2024-01-01").collect()}
    assert got == {(1, "n", None, "4"), (2, "s", "y", "z")}
