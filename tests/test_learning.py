import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import active, evaluation, models, preparation, synthetic


def test_stop_rule():
    assert active.should_stop(0.9, 0.8, 1, 10, False)
    assert active.should_stop(0.1, None, 10, 10, False)
    assert active.should_stop(0.1, 0.8, 1, 10, True)
    assert not active.should_stop(0.7, 0.8, 1, 10, False)
    assert not active.should_stop(0.9, 0.8, 1, 10, False, task="regression")


@pytest.mark.parametrize("block", [2, 5_000])
def test_coreset_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(active, "CENTRES_PER_PASS", block)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(60, 5))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>").repartition(4)
    got = active.coreset_batch(df.where("k >= 5"), df.where("k < 5"), "k", "v", 12).orderBy("pick").collect()
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    centres, pool, want = list(unit[:5]), list(range(5, 60)), []
    for _ in range(12):
        gaps = [min(np.linalg.norm(unit[i] - c) for c in centres) for i in pool]
        best = pool[int(np.argmax(gaps))]
        want.append(best)
        centres.append(unit[best])
        pool.remove(best)
    assert [r["k"] for r in got] == want


def test_uncertainty(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.0]), (2, [0.9, 0.1, 0.0])], "k int, probabilities array<double>")
    p = F.col("probabilities")
    rows = df.select(active.least_confidence(p), active.margin(p), active.entropy(p)).collect()
    assert [round(x, 6) for x in rows[0]] == [0.5, 1.0, 0.693147]
    assert [round(x, 6) for x in rows[1]] == [0.1, 0.2, 0.325083]


def test_auc_counts_pairs(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.4, 0), (0.05, 1)]
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p, a in rows if a for n, b in rows if not b]
    got = evaluation.roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y", digits=9).first()["roc_auc"]
    assert got == pytest.approx(sum(pairs) / len(pairs))
    assert evaluation.roc_auc(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", "y").first()["roc_auc"] is None


def test_metrics_without_hits(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "truth string, prediction string")
    row = evaluation.classification_metrics(df).first()
    assert (row["accuracy"], row["f1"], row["precision"], row["recall"]) == (0.0, 0.0, 0.0, 0.0)


def test_title_case(spark):
    texts = ["north-west", "o'neil STREET", " ab c", "x2y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(active.title_case(F.col("t"))).collect()] == [t.title() for t in texts]


def test_splits_are_stratified(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE concat('b', id % 7) END AS c")
    folds = evaluation.folds(df, "id", 5, "c").groupBy("c", "fold").count().collect()
    sizes = {}
    for r in folds:
        sizes.setdefault(r["c"], []).append(r["count"])
    assert all(max(s) - min(s) <= 1 for s in sizes.values())
    split = evaluation.holdout(df, "id", 0.1, "c").groupBy("c").agg(F.count_if("is_test").alias("t"), F.count("id").alias("n"))
    assert all(r["t"] == -(-r["n"] // 10) for r in split.collect())


def test_too_few_rows(spark):
    df = spark.range(9).selectExpr("id", "id AS y")
    with pytest.raises(ValueError, match="Too few rows"):
        evaluation.candidate_source(df, "y", "id")


def test_models_learn_and_failures_are_recorded(spark):
    df = spark.range(200).selectExpr(
        "id", "CAST(id % 20 AS DOUBLE) AS x", "concat('t', id % 3) AS t", "CASE WHEN id % 20 > 9 THEN 'hi' ELSE 'lo' END AS y"
    ).cache()
    chosen = [
        {"candidate_id": "good", "model_type": "logistic_regression"},
        {"candidate_id": "bad", "model_type": "no such model"},
    ]
    results, detail = models.run_benchmark(df, "y", "id", chosen, "holdout_80")
    rows = {r["candidate_id"]: r for r in results.collect()}
    assert rows["good"]["accuracy"] > 0.9 and rows["good"]["roc_auc"] > 0.95
    assert rows["bad"]["status"] == "failed" and "unknown model" in rows["bad"]["error_message"]
    assert evaluation.winner(results, "classification").first()["winner"] == "good"
    assert detail[0].importances[0][0] == "x"


def test_unknown_categories_are_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    features = preparation.Features(train, ["c"])
    assert features.names == ["c_a", "c_b", "c_missing"]
    row = features.transform(spark.createDataFrame([("z",)], "c string")).first()
    assert row["features"].toArray().tolist() == [0.0, 0.0, 0.0]


def test_copula_keeps_moments_and_dependence(spark):
    df = spark.range(5_000).selectExpr("id", "randn(1) AS a", "randn(2) AS e").selectExpr(
        "id", "a", "a * 2 + e * 0.5 + 10 AS b", "CASE WHEN a > 1 THEN 'top' ELSE 'rest' END AS c",
        "concat('name ', id) AS name",
    ).cache()
    model = synthetic.fit(df, ["a", "b", "c", "name"])
    out = synthetic.sample(model, 4_000, source=df, key="id").cache()
    again = synthetic.sample(model, 4_000, source=df.repartition(5), key="id")
    assert out.exceptAll(again).count() == 0
    real, made = (d.selectExpr("avg(b)", "stddev(b)", "corr(a, b)", "avg(int(c = 'top'))").first() for d in (df, out))
    assert made[0] == pytest.approx(real[0], abs=0.15)
    assert made[1] == pytest.approx(real[1], rel=0.05)
    assert made[2] == pytest.approx(real[2], abs=0.05)
    assert made[3] == pytest.approx(real[3], abs=0.03)
    assert out.join(df, "name", "left_semi").count() == 4_000


def test_registered_models_keep_the_operators_settings(spark, small, monkeypatch):
    """Every model under every preset is benchmarked, and no query sets its own number of trees."""
    from sluice.plans import all_queries

    class Seen(Exception):
        pass

    def seen(*found, **_):
        raise Seen(found)

    def first(query):
        with pytest.raises(Seen) as stopped:
            all_queries()[query](spark, small)
        return stopped.value.args[0]

    with monkeypatch.context() as patch:
        patch.setattr(models, "run_benchmark", seen)
        for query, kinds in (("bm_grid", models.MODELS), ("bm_cross_validated", models.MODELS), ("bm_regression", models.MODELS[:3])):
            for kind in kinds:
                chosen = first(f"{query}_{kind}")[3]
                assert [(c["model_type"], c["preset"]) for c in chosen] == [(kind, p) for p in models.PRESETS]
                assert not any("trees" in c for c in chosen)
    monkeypatch.setattr(models, "estimator", seen)
    for query in ("al_train", "al_batch", "al_predict"):
        assert first(query)[6:] in ((), (None,))


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_a_longer_boosted_model_begins_with_the_shorter_one(spark, kind):
    df = spark.range(120).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS z", "CAST(id % 17 > 7 AND id % 5 > 1 AS INT) AS y")
    prepared = models.prepare(df, "y", ["x", "z"], "id", kind, searched=True)
    est = models.estimator("xgboost", "grid_search", kind, 120, 2, 2)[0]
    fitted = {n: est.copy({est.maxIter: n, est.maxDepth: 3}).fit(prepared.ready) for n in (3, 8)}
    short, cut = fitted[3], models.first_trees(fitted[8], 3)
    assert cut.treeWeights == short.treeWeights and [t.toDebugString.split("\n", 1)[1] for t in cut.trees] == [t.toDebugString.split("\n", 1)[1] for t in short.trees]
    told = [m.transform(prepared.ready).select("label", "prediction").collect() for m in (cut, short)]
    assert sorted(told[0]) == sorted(told[1])
    prepared.release()


def test_one_vs_rest_models_are_searched(spark):
    df = spark.range(90).selectExpr("id", "CAST(id % 9 AS DOUBLE) AS x", "CAST(id % 9 DIV 3 AS STRING) AS y")
    est, grid = models.estimator("svm", "grid_search", "classification", 90, 1, 3)
    assert [g[est.classifier].getRegParam() for g in grid] == [models._penalty(c, 90) for c in (0.1, 1.0, 10.0)]
    assert len(models.estimator("xgboost", "grid_search", "classification", 90, 1, 3)[1]) == 8


def test_deep_forests_keep_the_nodes_of_rows_and_stay_the_same(spark):
    df = spark.range(150).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id * 7 % 11 AS DOUBLE) AS z", "CAST(id % 17 > 7 AND id % 5 > 1 AS STRING) AS y")
    prepared = models.prepare(df, "y", ["x", "z"], "id")
    est = models.estimator("random_forest", "default", "classification", 150, 2, 2, trees=5)[0]
    assert est.getCacheNodeIds()
    ours, plain = est.fit(prepared.ready), est.copy({est.cacheNodeIds: False}).fit(prepared.ready)
    assert [t.toDebugString.split("\n", 1)[1] for t in ours.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]
    prepared.release()


def test_splits_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    together, fit = threading.Barrier(6), models.fit_prepared

    def seen(*args, **options):
        together.wait(timeout=60)  # breaks unless the five folds and all rows are fitted at once
        return fit(*args, **options)

    monkeypatch.setattr(models, "fit_prepared", seen)
    df = spark.range(120).selectExpr("id", "CAST(id % 20 AS DOUBLE) AS x", "CASE WHEN id % 20 > 9 THEN 'hi' ELSE 'lo' END AS y").cache()
    results, detail = models.run_benchmark(df, "y", "id", [{"candidate_id": "a", "model_type": "logistic_regression", "preset": "grid_search"}], "kfold_5")
    row = results.first()
    assert row["status"] == "complete" and row["accuracy"] > 0.9 and sum(n for _, _, n in detail[0].confusion) == 120


def test_support_vector_machines_take_their_steps_in_the_same_jobs(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC

    steps, sums = [], models.margins.Together._sums
    monkeypatch.setattr(models.margins.Together, "_sums", lambda self, *a: steps.append(1) or sums(self, *a))
    df = spark.range(240).selectExpr(
        "id", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id * 7 % 11 AS DOUBLE) AS z", "CASE WHEN id % 17 + id * 5 % 7 > 11 THEN 'hi' ELSE 'lo' END AS y"
    ).cache()
    parts = [models.prepare(df.where(f"id % 5 <> {i}"), "y", ["x", "z"], "id", searched=True) for i in (0, 1)]

    def loss(model, rows, penalty):
        x, y = np.array([r["features"].toArray() for r in rows]), np.array([2 * r["label"] - 1 for r in rows])
        w = model.coefficients.toArray()
        return np.maximum(0, 1 - y * (x @ w + model.intercept)).mean() + penalty / 2 * (w @ w)

    found = models.fit_all(parts, "svm", "grid_search")
    assert 0 < len(steps) < 600  # 20 fits of 100 steps would be thousands of jobs
    part, fitted = parts[1], found[1]
    penalty, rows = fitted.model.getRegParam(), part.ready.collect()
    plain = LinearSVC(regParam=penalty, maxIter=100, standardization=False).fit(part.ready)
    assert loss(fitted.model, rows, penalty) <= loss(plain, rows, penalty) * 1.001
    told = [[r[0] for r in m.transform(part.ready).select("prediction").collect()] for m in (fitted.model, plain)]
    assert np.mean(np.array(told[0]) == np.array(told[1])) > 0.95
    for part in parts:
        part.release()


def test_rows_without_a_label_are_refused_by_support_vector_machines(spark):
    df = spark.range(60).selectExpr("id", "CAST(id % 9 AS DOUBLE) AS x", "CASE WHEN id % 9 > 4 THEN 'hi' WHEN id % 9 > 0 THEN 'lo' END AS y").cache()
    results, _ = models.run_benchmark(df, "y", "id", [{"candidate_id": "a", "model_type": "svm"}], "kfold_5")
    row = results.first()
    assert row["status"] == "failed" and "label" in row["error_message"].lower()


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_a_search_grows_the_longest_forest_per_depth_and_fold(spark, monkeypatch, kind):
    forest = models.RandomForestClassifier if kind == "classification" else models.RandomForestRegressor
    grown, fit = [], forest.fit
    monkeypatch.setattr(forest, "fit", lambda self, *a: grown.append((self.getNumTrees(), self.getMaxDepth())) or fit(self, *a))
    df = spark.range(120).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id * 7 % 11 AS DOUBLE) AS z", "CAST(id % 17 > 7 AND id % 5 > 1 AS INT) AS y")
    prepared = models.prepare(df, "y", ["x", "z"], "id", kind, searched=True)
    est, _ = models.estimator("random_forest", "grid_search", kind, 120, 2, 2)
    grid = [{est.numTrees: n, est.maxDepth: d} for n in (3, 5, 8) for d in (2, 4)]
    judge = models.MulticlassClassificationEvaluator(metricName="accuracy") if kind == "classification" else models.RegressionEvaluator(metricName="r2")
    best = models._search(est, grid, prepared.ready, judge)
    assert sorted(grown[:6]) == [(8, 2)] * 3 + [(8, 4)] * 3 and len(grown) == 7 and best.getNumTrees == grown[6][0]
    told = [models.first_trees(best, 2).transform(prepared.ready), best.transform(prepared.ready)]
    first = models.first_trees(best, 2)
    assert [t.toDebugString for t in first.trees] == [t.toDebugString for t in best.trees[:2]]
    assert all(t.where("prediction IS NULL").count() == 0 for t in told)
    prepared.release()
