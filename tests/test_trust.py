"""Label noise, formats, missing values, odd rows and synthetic rows, on planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import quantiles
from sluice.operators import fidelity, missingness, noise, outliers, quality, standardize


def test_planted_label_flips_are_found(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        label = i % 2
        flipped = i % 25 == 0
        rows.append((i, rng.gauss(4.0 * label, 1.0), rng.gauss(-3.0 * label, 1.0), str(1 - label if flipped else label), flipped))
    df = spark.createDataFrame(rows, "id bigint, x double, y double, label string, flipped boolean")
    found = noise.label_issues(df.drop("flipped"), "label", ["x", "y"], "id", k=4)
    issues = {r["id"] for r in found.where("is_issue").collect()}
    planted = {r[0] for r in rows if r[4]}
    assert len(issues & planted) >= 0.9 * len(planted) and len(issues - planted) <= 8
    assert found.count() == 400
    rates = {r["label"]: r["noise_rate"] for r in noise.noise_rates(noise.confident_joint(found, "label")).collect()}
    assert all(0.01 < rate < 0.12 for rate in rates.values())


def test_rows_speak_for_classes_whose_threshold_they_reach(spark):
    rows = [(1, "a", [0.9, 0.1]), (2, "a", [0.75, 0.25]), (3, "b", [0.85, 0.15]), (4, "b", [0.2, 0.8]), (5, None, [0.9, 0.1]), (6, "a", [0.5, 0.5]), (7, "z", [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id int, label string, p array<double>")
    got = {r["id"]: (r["suggested"], r["is_issue"]) for r in noise.judged_labels(df, "label", "p", ["a", "b"]).collect()}
    # thresholds: a 0.717, b 0.475
    assert got == {1: ("a", False), 2: ("a", False), 3: ("a", True), 4: ("b", False), 5: ("a", False), 6: ("b", True), 7: ("a", True)}


def test_formats_are_read_or_rejected(spark, tmp_path):
    rows = [
        (1, "2024-01-02", "1,234.5", "yes", "Café  x"), (2, "2.1.2024", "(3)", "OFF", "a\x07\tb"), (3, "Jan 5, 2024", "12 %", None, None), (4, "5 Feb 2024", "€7", "1", ""),
        (5, "2024-02-30", "seven", "maybe", "t"), (6, None, None, None, "t"), (7, " ", "", "n", "t"), (8, "20240229", "-4.5", "t", "t"),
    ]
    df = spark.createDataFrame(rows, "id int, day string, amount string, flag string, text string")
    rules = (standardize.Dates("day"), standardize.Numbers("amount"), standardize.Flags("flag"), standardize.Texts("text"))
    good = {r["id"]: (str(r["day"])[:10], r["amount"], r["flag"], r["text"]) for r in standardize.good_rows(df, rules).collect()}
    assert good == {
        1: ("2024-01-02", 1234.5, True, "Café x"), 2: ("2024-01-02", -3.0, False, "a b"), 3: ("2024-01-05", 0.12, None, None), 4: ("2024-02-05", 7.0, True, ""),
        6: ("None", None, None, "t"), 7: ("None", None, False, "t"), 8: ("2024-02-29", -4.5, True, "t"),
    }
    bad = standardize.rejects(df, rules).collect()
    assert [tuple(r) for r in bad] == [(5, "2024-02-30", "seven", "maybe", "t", "day: no date; amount: no number; flag: no flag")]
    kept, held = standardize.write_split(df, rules, f"{tmp_path}/split")
    assert kept.count() == 7 and [tuple(r) for r in held.collect()] == [tuple(r) for r in bad]


def test_numbers_with_a_decimal_comma(spark):
    df = spark.createDataFrame([("1.234,5",)], "x string")
    assert standardize.good_rows(df, [standardize.Numbers("x", thousands=".", decimal=",")]).first()[0] == 1234.5


def test_columns_that_tell_what_is_missing(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        group, x = rng.choice("uvw"), rng.random()
        by_group = None if group == "u" and rng.random() < 0.5 else x
        at_random = None if rng.random() < 0.2 else x
        rows.append((group, x, by_group, at_random, None if i < 5 else 1.0))
    df = spark.createDataFrame(rows, "g string, x double, by_group double, at_random double, few double")
    got = {r["column"]: (r["kind"], r["depends_on"]) for r in missingness.missingness(df).collect()}
    assert got == {"g": ("none", None), "x": ("none", None), "by_group": ("MAR", "g"), "at_random": ("MCAR", None), "few": ("unknown", None)}
    pair = missingness.associations(df).where("column = 'by_group' AND other = 'g'").first()
    table = np.zeros((3, 2))
    for g, _, b, _, _ in rows:
        table["uvw".index(g), int(b is None)] += 1
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert pair["chi_square"] == pytest.approx(((table - expected) ** 2 / expected).sum(), abs=1e-5) and pair["dof"] == 2


def test_rows_need_votes_of_several_columns(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(0, 1), rng.expovariate(1), 5.0) for i in range(8000)] + [(9000, 6.0, 90.0, 5.0), (9001, 6.0, None, 5.0), (9002, None, 90.0, 6.0)]
    df = spark.createDataFrame(rows, "id int, bell double, tail double, fixed double")
    named = {r["column"]: r["method"] for r in outliers.methods(df, ["bell", "tail", "fixed"]).collect()}
    assert named == {"bell": "z-score", "tail": "fences", "fixed": "none"}
    got = {r["id"]: r["voters"] for r in outliers.votes(df, ["bell", "tail", "fixed"]).collect()}
    assert got == {9000: "bell,tail"}
    assert outliers.votes(df.where("false"), ["bell", "tail"]).count() == 0


def test_critical_columns_cost_points(spark):
    scores = spark.createDataFrame([(80.0, 100.0, 50.0, 60.0, 70.0, 40.0)], "overall double, completeness double, consistency double, accuracy double, distribution double, label_quality double")
    columns = spark.createDataFrame([("a", 100.0), ("b", 45.0)], "column string, quality_score double")
    got = quality.weighted_score(scores, columns, {"completeness": 1, "accuracy": 1}, [("a", 90, 10), ("b", 90, 10), ("c", 90, 4)]).first()
    assert tuple(got) == (80.0, 9.0, 71.0)
    assert quality.weighted_score(scores, columns, {"consistency": 1}, [("b", 90, 200)]).first()["final"] == 0.0
    with pytest.raises(ValueError):
        quality.weighted_score(scores, columns, {"beauty": 1})


def test_largest_gap_of_distributions(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=700), 2), np.round(rng.normal(0.3, 1, size=500), 2)
    frame = lambda v: spark.createDataFrame([(float(x), float(-x)) for x in v] + [(None, None)], "x double, y double").repartition(5)
    got = {r["column"]: r for r in fidelity.kolmogorov_smirnov(frame(a), frame(b), ["x", "y"]).collect()}
    at = np.unique(np.concatenate([a, b]))
    want = np.abs(np.searchsorted(np.sort(a), at, "right") / 700 - np.searchsorted(np.sort(b), at, "right") / 500).max()
    for r in got.values():
        assert r["statistic"] == pytest.approx(want, abs=1e-6) and (r["n_real"], r["n_synthetic"]) == (700, 500) and r["p_value"] < 0.01


def test_nearest_real_rows_are_found(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    real, made = vectors.where("vec_id % 4 <> 0"), vectors.where("vec_id % 4 = 0").unionByName(vectors.where("vec_id = 1"))
    got = {r["vec_id"]: r for r in fidelity.nearest_real(real, made, "vec_id", "embedding").collect()}
    held = np.array([r[0] for r in real.select("embedding").collect()])
    exact = {r[0]: np.sort(np.sqrt(((held - np.array(r[1])) ** 2).sum(axis=1)))[:2] for r in made.collect()}
    hits = [got[k]["distance"] is not None and abs(got[k]["distance"] - want[0]) < 1e-6 for k, want in exact.items()]
    assert np.mean(hits) >= 0.9
    assert got[1]["real_id"] == 1 and got[1]["distance"] == 0 and got[1]["ratio"] == 0
    summary = fidelity.privacy_summary(fidelity.nearest_real(real, made, "vec_id", "embedding")).first()
    assert (summary["rows"], summary["copies"], summary["exposed"]) == (len(exact), 1, 1)


def test_a_model_that_cannot_be_trained_is_reported(spark):
    real = spark.createDataFrame([(i, float(i % 7), "a" if i % 2 else "b") for i in range(100)], "id bigint, x double, kind string")
    got = fidelity.usefulness(real, real.where("kind = 'a'").limit(0), "kind", "id").collect()
    assert [r["trained_on"] for r in got] == ["real", "synthetic"] and got[0]["status"] == "complete" and got[1]["status"] == "failed" and got[1]["gap"] is None


@pytest.mark.parametrize(("most", "accuracy"), [(1_000_000, 10_000), (1_000, 100)])
def test_quantiles_are_exact_where_one_value_fills_a_column(spark, monkeypatch, most, accuracy):
    monkeypatch.setattr(quantiles, "MOST_IN_A_BRACKET", most)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)  # small: brackets are sketched again
    rng = np.random.default_rng(4)
    n = 60_000
    data = {"even": rng.normal(size=n), "full": np.where(rng.random(n) < 0.99, 7.0, rng.normal(size=n)), "steps": rng.integers(0, 5, n).astype(float)}
    df = spark.range(n).repartition(6)
    packed = spark.createDataFrame([(i, *(float(v[i]) for v in data.values())) for i in range(n)], "id bigint, even double, full double, steps double")
    df = df.join(packed, "id").withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.004, 0.25, 0.5, 0.75, 0.997, 1.0]
    got = {r["column"]: (r["n"], r["q"]) for r in quantiles.quantiles(df, [*data, "none"], probs).collect()}
    for c, values in data.items():
        assert got[c][0] == n and np.allclose(got[c][1], np.quantile(values, probs), rtol=1e-12, atol=1e-12)
    assert got["none"] == (0, None)
