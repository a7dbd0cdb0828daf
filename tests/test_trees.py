import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import models, trees


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).selectExpr("id", "CAST(id * 7919 % 1009 AS DOUBLE) AS x", "CAST(id * 31 % 53 AS DOUBLE) AS z", "concat('c', id * 17 % 5) AS c", "rand(3) AS r")
    return df.selectExpr("*", "CAST((x > 400 AND z > 11) OR r < 0.2 AS INT) AS y", "x / 100 + z * r AS v").cache()


def _told(model, prepared):
    return np.array([r[0] for r in model.transform(prepared.ready).select("prediction").collect()])


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_boosted_trees_are_those_of_spark(spark, rows, kind):
    prepared = models.prepare(rows, "y" if kind == "classification" else "v", ["x", "z", "c"], "id", kind)
    est = models.estimator("xgboost", "default", kind, 600, 7, 2, trees=6)[0]
    plain, ours = est.fit(prepared.ready), models.fit_prepared(prepared, "xgboost", "default", 6).model
    assert isinstance(ours, trees.Grown) and ours.weights == list(plain.treeWeights)
    if kind == "regression":
        assert _told(ours, prepared) == pytest.approx(_told(plain, prepared))
        assert ours.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=0.02)  # equal gains may be rounded otherwise
    else:
        assert np.mean(_told(ours, prepared) == _told(plain, prepared)) > 0.98
    prepared.release()


@pytest.mark.parametrize("model", ["xgboost", "random_forest"])
@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_a_search_of_trees_takes_two_jobs(spark, rows, monkeypatch, model, kind):
    """The scores of all settings and folds are one job, the best settings another, whatever the number of trees and splits."""

    def never(*_):
        raise AssertionError("fitted apart")

    for kinds in (models.GBTClassifier, models.GBTRegressor, models.RandomForestClassifier, models.RandomForestRegressor):
        monkeypatch.setattr(kinds, "fit", never)
    jobs, grow = [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda parts, counts, wanted: jobs.append(wanted) or grow(parts, counts, wanted))
    target = "y" if kind == "classification" else "v"
    parts = [models.prepare(rows.where(f"id % 5 <> {i}"), target, ["x", "z", "c"], "id", kind, searched=True) for i in (0, 1)]
    found = models.fit_all(parts, model, "grid_search", 4)
    assert len(jobs) == 2 and [w.part for w in jobs[1]] == [0, 1] and all(w.without is None for w in jobs[1])
    assert {(w.step, d, n) for w in jobs[0] for d in w.depths for n in w.lengths} == (
        {(s, d, 4) for s in (0.05, 0.1) for d in (4, 6)} if model == "xgboost" else {(0.0, d, 4) for d in (10, 20)}
    )
    assert len(jobs[0]) == 2 * 3 * (4 if model == "xgboost" else 1)
    for part, fitted in zip(parts, found):
        told = np.array([tuple(r) for r in fitted.model.transform(part.ready).select("label", "prediction").collect()])
        assert np.mean((told[:, 0] - told[:, 1]) ** 2) < 0.6 * np.var(told[:, 0])
        assert fitted.importances(3)[0][0] in ("x", "z")
        part.release()


def test_forests_are_as_large_as_those_of_spark(spark, rows):
    prepared = models.prepare(rows, "y", ["x", "z", "c"], "id")
    est = models.estimator("random_forest", "tuned", "classification", 600, 7, 2, trees=40)[0]
    plain, ours = est.fit(prepared.ready), models.fit_prepared(prepared, "random_forest", "tuned", 40).model
    assert len(ours.trees) == 40
    assert np.mean([len(t.left) for t in ours.trees]) == pytest.approx(np.mean([t.numNodes for t in plain.trees]), rel=0.15)
    chance = [np.array([r["probability"][1] for r in m.transform(prepared.ready).collect()]) for m in (plain, ours)]
    assert np.corrcoef(*chance)[0, 1] > 0.9
    prepared.release()


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_forests_do_not_hang_on_the_order_of_rows(spark, rows, kind):
    prepared = models.prepare(rows, "y" if kind == "classification" else "v", ["x", "z", "c"], "id", kind)
    wanted = [trees.Wanted(0, None, False, 2 if kind == "classification" else 0, (6,), (3,), 0.0, 1, 42)]
    found = [trees.grow([df], [600], wanted)[0]["trees"] for df in (prepared.ready, prepared.ready.repartition(5).sortWithinPartitions(F.rand()))]
    for a, b in zip(*found):
        assert (a.left == b.left).all() and a.value == pytest.approx(b.value)
    prepared.release()


def test_weighted_rows_stand_for_copies():
    """Rows in the same bins and with the same label are one row with a weight; boosted trees do not change by it."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 4, (400, 3)).astype(np.uint8), rng.normal(size=400)
    each = trees.Rows(x, np.zeros(400, np.int16), None, y)
    merged = each.merged([4, 4, 4], "sums")
    assert len(merged.s) < 70 and merged.n.sum() == 400
    wanted = trees.Wanted(0, None, True, 0, (3,), (5,))
    none = each.at(np.zeros(0, dtype=int))
    whole, short = (trees.boosted(r, none, [4, 4, 4], wanted)[0] for r in (each, merged))
    probe = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)], dtype=np.uint8)
    told = [sum(w * t.leaves(probe) for w, t in zip([1.0] + [0.1] * 4, found)) for found in (whole, short)]
    assert told[0] == pytest.approx(told[1])


def test_a_shallow_tree_is_the_beginning_of_the_deep_one():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 8, (300, 4)).astype(np.uint8), rng.integers(0, 2, 300).astype(float)
    levels = trees._resampled(x, np.ones(300), y, 2, 12, 1, 2, 8, np.random.default_rng(1))
    again = trees._resampled(x, np.ones(300), y, 2, 3, 1, 2, 8, np.random.default_rng(1))
    share, same = (lambda t: t / t.sum(axis=1, keepdims=True)), (lambda t: t.argmax(axis=1))
    cut, own = levels.ended(4, 3, share, same)[0], again.ended(4, 12, share, same)[0]
    assert (cut.left == own.left).all() and (cut.value == own.value).all() and len(levels.starts) > 5


def test_wide_or_many_rows_are_left_to_spark():
    assert trees.fits_a_task(100_000, 30) and not trees.fits_a_task(100, 4_096) and not trees.fits_a_task(50_000_000, 30)


def test_rows_without_a_label_are_refused_by_trees(spark):
    df = spark.range(60).selectExpr("id", "CAST(id % 9 AS DOUBLE) AS x", "CASE WHEN id % 9 > 4 THEN 'hi' WHEN id % 9 > 0 THEN 'lo' END AS y").cache()
    results, _ = models.run_benchmark(df, "y", "id", [{"candidate_id": "a", "model_type": "xgboost", "trees": 2}, {"candidate_id": "b", "model_type": "random_forest", "trees": 2}], "kfold_5")
    assert [(r["status"], "label" in r["error_message"].lower()) for r in results.collect()] == [("failed", True)] * 2


def test_resamples_are_poisson_counts():
    counts = trees.resampled_ones(400_000, np.random.default_rng(3))
    assert counts.mean() == pytest.approx(1.0, abs=0.01) and counts.var() == pytest.approx(1.0, abs=0.02)
    assert (counts == 0).mean() == pytest.approx(np.exp(-1), abs=0.005) and 6 <= counts.max() <= 12
