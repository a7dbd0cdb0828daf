"""Train, compare and use models with Spark ML."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.draws import uniform
from sluice.operators import active, evaluation, margins, preparation
from sluice.operators import trees as grown_trees
from sluice.session import materialize, small_frame

SEED = 42
ROWS_PER_PARTITION = 20_000
DEEPEST = 20  # Spark trees have a depth limit; this stands for "unlimited"
MODELS = ("logistic_regression", "random_forest", "xgboost", "svm", "mlp")
PRESETS = ("default", "tuned", "grid_search")


# --- estimators --------------------------------------------------------------------


def _penalty(c: float, rows: int) -> float:
    """Spark averages the loss, so an inverse strength C becomes 1 / (C * rows)."""
    return 1.0 / (c * max(rows, 1))


def estimator(model: str, preset: str, task: str, rows: int, features: int, n_classes: int, trees: int | None = None):
    """The estimator of a model and preset, and its parameter grid (empty but for grid search)."""
    classify = task == "classification"
    grid = ParamGridBuilder()
    search = preset == "grid_search"
    tuned = preset == "tuned"
    if model == "logistic_regression":
        c = 0.1 if tuned else 1.0
        if classify:
            est = LogisticRegression(regParam=_penalty(c, rows), maxIter=200 if tuned else 100, standardization=False)
        else:
            est = LinearRegression(regParam=_penalty(c, rows), standardization=False)
        if search:
            grid.addGrid(est.regParam, [_penalty(v, rows) for v in (0.01, 0.1, 1.0, 10.0)])
    elif model == "random_forest":
        kind = RandomForestClassifier if classify else RandomForestRegressor
        # with the rows' nodes kept, a level ships no trees: deep forests take less than half the time and are the same
        est = kind(numTrees=trees or (200 if tuned else 100), maxDepth=15 if tuned else DEEPEST, seed=SEED,
                   minInstancesPerNode=3 if tuned else 1, cacheNodeIds=True)
        if search:
            grid.addGrid(est.numTrees, [trees] if trees else [50, 100, 200]).addGrid(est.maxDepth, [10, DEEPEST])
    elif model == "xgboost":
        kind = GBTClassifier if classify else GBTRegressor
        est = kind(maxIter=trees or (200 if tuned else 100), stepSize=0.05 if tuned else 0.1, maxDepth=6, seed=SEED)
        settings = [(n, step, depth) for n in ([trees] if trees else [100, 200]) for step in (0.05, 0.1) for depth in (4, 6)]
        if classify and n_classes > 2:
            wrapped = [est.copy({est.maxIter: n, est.stepSize: step, est.maxDepth: depth}) for n, step, depth in settings]
            est = OneVsRest(classifier=est)
            grid.addGrid(est.classifier, wrapped)
        elif search:
            grid.addGrid(est.maxIter, sorted({n for n, _, _ in settings})).addGrid(est.stepSize, [0.05, 0.1]).addGrid(est.maxDepth, [4, 6])
    elif model == "svm":
        if not classify:
            raise ValueError("a support vector regressor has no Spark counterpart")
        c = 10.0 if tuned else 1.0
        est = LinearSVC(regParam=_penalty(c, rows), maxIter=100, standardization=False)
        strengths = [_penalty(v, rows) for v in (0.1, 1.0, 10.0)]
        if n_classes > 2:
            wrapped = [est.copy({est.regParam: v}) for v in strengths]
            est = OneVsRest(classifier=est)
            grid.addGrid(est.classifier, wrapped)
        elif search:
            grid.addGrid(est.regParam, strengths)
    elif model == "mlp":
        if not classify:
            raise ValueError("a neural regressor has no Spark counterpart")
        hidden = [200, 100] if tuned else [100]
        est = MultilayerPerceptronClassifier(layers=[features, *hidden, n_classes], maxIter=100, seed=SEED)
        if search:
            grid.addGrid(est.layers, [[features, *h, n_classes] for h in ([100], [200], [100, 50])])
    else:
        raise ValueError(f"unknown model {model}")
    return est, (grid.build() if search else [])


@dataclass
class Fitted:
    """A fitted model with its preparation and class names."""

    features: preparation.Features
    model: Model | grown_trees.Grown
    classes: list[str]
    task: str

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted_label`` and, where the model has them, ``probabilities``."""
        return self.predict_prepared(self.features.transform(df), df.columns)

    def predict_prepared(self, ready: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The same for rows that have their ``features``; of the others ``columns`` stay."""
        out = self.model.transform(ready)
        if self.task != "classification":
            return out.select(*columns, F.col("prediction").alias("predicted_label"))
        names = F.array(*[F.lit(c) for c in self.classes])
        picks = [F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted_label")]
        if "probability" in out.columns:
            picks.append(vector_to_array("probability").alias("probabilities"))
        if "rawPrediction" in out.columns and len(self.classes) == 2:
            picks.append(F.element_at(vector_to_array("rawPrediction"), 2).alias("second_class_score"))
        return out.select(*columns, *picks)

    def importances(self, top: int = 10, digits: int | None = None) -> list[tuple[str, float]]:
        """The most important features: tree importances or mean absolute coefficients."""
        model = getattr(self.model, "bestModel", self.model)
        if hasattr(model, "featureImportances"):
            values = model.featureImportances.toArray()
        elif hasattr(model, "coefficientMatrix"):
            values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(model, "coefficients"):
            values = np.abs(model.coefficients.toArray())
        else:
            return []
        pairs = sorted(zip(values.tolist(), self.features.names), key=lambda p: (-p[0], p[1]))[:top]
        return [(name, round(v, digits) if digits is not None else v) for v, name in pairs]


def compact(df: DataFrame, rows: int) -> DataFrame:
    """Training rows dealt evenly over partitions of ``ROWS_PER_PARTITION``: iterative fits run many short jobs.

    Only the training rows are shuffled; what reads and joins them keeps its own partitions.
    """
    return df.repartition(max(1, math.ceil(rows / ROWS_PER_PARTITION)))


def cut(df: DataFrame) -> DataFrame:
    """The rows cached, without the plan that made them: every fit and prediction on them is planned anew."""
    first = df.persist()
    kept = materialize(first).persist()
    first.unpersist()
    return kept


def _labelled(df: DataFrame, target: str, classes: Sequence[str]) -> Column:
    if not classes:
        return F.col(target).cast("double")
    codes = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return codes[F.col(target).cast("string")]


@dataclass
class Prepared:
    """Training rows with features and a numbered label, ready for any candidate; ``ready`` is cached until :meth:`release`."""

    features: preparation.Features
    classes: list[str]
    task: str
    ready: DataFrame

    def release(self) -> None:
        self.ready.unpersist()


SEARCH_FOLDS = 3


def prepare(
    train: DataFrame, target: str, columns: Sequence[str], key: str, task: str = "classification", classes: Sequence[str] | None = None,
    most_frequent: bool = False, searched: bool = False,
) -> Prepared:
    """Features fitted on ``train``; with ``searched`` also the folds of a grid search."""
    classify = task == "classification"
    if classify and classes is None:
        classes = preparation.categories(train, target, preparation.MAX_INDICATORS)
        if classes is None:
            raise ValueError(f"{target} has too many classes")
    classes = list(classes or []) if classify else []
    features = preparation.Features(train, columns, most_frequent)
    rows = train.drop("fold") if searched else train
    split = evaluation.folds(rows, key, SEARCH_FOLDS, target if classify else None) if searched else rows
    ready = features.transform(split).withColumn("label", _labelled(split, target, classes))
    kept = ready.select("features", "label", *(["fold"] if searched else []))
    return Prepared(features, classes, task, compact(kept, features.rows).persist())


def _estimator_of(prepared: Prepared, model: str, preset: str, trees: int | None = None) -> tuple[Estimator, list[dict]]:
    return estimator(model, preset, prepared.task, prepared.features.rows, len(prepared.features.names), max(2, len(prepared.classes)), trees)


def fit_prepared(prepared: Prepared, model: str = "random_forest", preset: str = "default", trees: int | None = None, grown: bool = True) -> Fitted:
    """One model on prepared rows; a grid search takes the best of 3 folds. Unless ``grown``, trees are Spark's own."""
    classes = prepared.classes
    est, grid = _estimator_of(prepared, model, preset, trees)
    found = _machines([prepared], preset) if isinstance(est, LinearSVC) else _trees([prepared], model, preset, trees) if grown else None
    if found:
        return found[0]
    if not grid:
        with FITS:
            return Fitted(prepared.features, est.fit(prepared.ready), classes, prepared.task)
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if prepared.task == "classification" else RegressionEvaluator(metricName="r2")
    return Fitted(prepared.features, _search(est, grid, prepared.ready, judge), classes, prepared.task)


AT_ONCE = 12
FITS = threading.BoundedSemaphore(AT_ONCE)  # over all candidates, splits and folds; held by fits only, never while waiting for others


def side_by_side(spark: SparkSession, run: Callable, jobs: Sequence) -> list:
    """``run`` of every job on a thread of its own; the fits in them take turns by ``FITS``."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as workers:
        return list(workers.map(inheritable_thread_target(spark)(run), jobs))


def fit_all(prepared: Sequence[Prepared], model: str = "random_forest", preset: str = "default", trees: int | None = None) -> list[Fitted]:
    """A model for each, fitted side by side; support vector machines of two classes take their steps in the same jobs, trees grow in one job."""
    if model == "svm" and all(p.task == "classification" and len(p.classes) <= 2 for p in prepared):
        found = _machines(prepared, preset)
        if found:
            return found
    found = _trees(prepared, model, preset, trees)
    if found:
        return found
    spark = prepared[0].ready.sparkSession
    return side_by_side(spark, lambda p: fit_prepared(p, model, preset, trees), prepared)


def _machines(prepared: Sequence[Prepared], preset: str) -> list[Fitted] | None:
    """Support vector machines of two classes for all at once; a search fits all its settings and folds at once, then the best settings.

    None where rows are wide or cannot be fitted on: Spark's own estimator takes those, or says what is wrong.
    """
    if any(len(p.features.names) > margins.WIDEST for p in prepared):
        return None
    made = [_estimator_of(p, "svm", preset) for p in prepared]
    rounds, tolerance = made[0][0].getMaxIter(), made[0][0].getTol()
    with FITS:
        together = margins.Together([p.ready for p in prepared])
        try:
            chosen = [est.getRegParam() for est, _ in made]
            if made[0][1]:
                grids = [[setting[est.regParam] for setting in grid] for est, grid in made]
                tried = [margins.Wanted(i, fold, c) for i, grid in enumerate(grids) for c in grid for fold in range(SEARCH_FOLDS)]
                found = together.fit(tried, rounds, tolerance)
                if found is None:
                    return None
                scores = {(w.part, w.penalty, w.without): s for w, s in zip(tried, together.accuracies(tried, found))}
                mean = lambda i, c: sum(scores[i, c, fold] for fold in range(SEARCH_FOLDS)) / SEARCH_FOLDS
                chosen = [max(grid, key=lambda c: mean(i, c)) for i, grid in enumerate(grids)]  # the first of equally good settings
            found = together.fit([margins.Wanted(i, None, c) for i, c in enumerate(chosen)], rounds, tolerance)
        finally:
            together.release()
    if found is None:
        return None
    context = SparkContext._active_spark_context
    out = []
    for p, (est, _), c, weights in zip(prepared, made, chosen, found):
        est = est.copy({est.regParam: c})
        own = context._jvm.org.apache.spark.ml.classification.LinearSVCModel(est.uid, _py2java(context, DenseVector(weights[:-1])), float(weights[-1]))
        out.append(Fitted(p.features, est._copyValues(LinearSVCModel(own)), p.classes, p.task))
    return out


def _trees(prepared: Sequence[Prepared], model: str, preset: str, n: int | None = None) -> list[Fitted] | None:
    """Forests, and boosted trees of values or two classes, for all at once, each fit in a task of its own; a search scores all its settings and folds at once, then grows the best.

    None for other models and where the rows of a fit are too many for a task or cannot be fitted on: Spark's own estimator takes those, or says what is wrong.
    """
    wanted_classes = [max(2, len(p.classes)) if p.task == "classification" else 0 for p in prepared]
    if model not in ("xgboost", "random_forest") or model == "xgboost" and max(wanted_classes) > 2:
        return None
    if not all(grown_trees.fits_a_task(p.features.rows, len(p.features.names)) for p in prepared):
        return None
    boosted = model == "xgboost"
    made = [_estimator_of(p, model, preset, n) for p in prepared]
    rounds, step = ("maxIter", "stepSize") if boosted else ("numTrees", None)

    def of(est: Estimator, setting: dict, name: str | None):
        return setting.get(est.getParam(name), est.getOrDefault(name)) if name else 0.0

    def wish(part: int, without: int | None, settings: Sequence[tuple]) -> grown_trees.Wanted:
        """The fit that holds all these settings (step, depth, length), which differ in what one fit can tell of."""
        est, steps = made[part][0], {s for s, _, _ in settings}
        depths, lengths = (tuple(sorted({s[i] for s in settings})) for i in (1, 2))
        return grown_trees.Wanted(part, without, boosted, wanted_classes[part], depths, lengths, *steps, est.getMinInstancesPerNode(), est.getSeed())

    grids = [[(of(est, g, step), of(est, g, "maxDepth"), of(est, g, rounds)) for g in grid or [{}]] for est, grid in made]
    with FITS:
        parts, counts = [p.ready for p in prepared], [p.features.rows for p in prepared]
        chosen = [grid[0] for grid in grids]
        if made[0][1]:
            tried, at = [], {}
            for i, grid in enumerate(grids):
                for group in sorted({g[:2] if boosted else () for g in grid}):  # a boosted model has one depth, a forest's shallow trees begin its deep ones
                    for fold in range(SEARCH_FOLDS):
                        own = [g for g in grid if g[: len(group)] == group]
                        at |= {(i, g, fold): len(tried) for g in own}
                        tried.append(wish(i, fold, own))
            found = grown_trees.grow(parts, counts, tried)
            if found is None:
                return None
            mean = lambda i, g: sum(found[at[i, g, fold]]["scores"][g[1:]] for fold in range(SEARCH_FOLDS)) / SEARCH_FOLDS
            chosen = [max(grid, key=lambda g: mean(i, g)) for i, grid in enumerate(grids)]  # the first of equally good settings
        found = grown_trees.grow(parts, counts, [wish(i, None, [g]) for i, g in enumerate(chosen)])
    if found is None:
        return None
    models = [grown_trees.Grown(f["trees"], f["weights"], f["worth"], f["cuts"], c) for f, c in zip(found, wanted_classes)]
    return [Fitted(p.features, m, p.classes, p.task) for p, m in zip(prepared, models)]


def first_trees(model: Model, n: int) -> Model:
    """The model of the first ``n`` trees. Of a boosted model without row or feature sampling that is the model of ``n`` rounds, of a forest, whose trees are drawn apart, a forest of ``n`` trees."""
    own = model._java_obj
    context = SparkContext._active_spark_context
    ml = context._jvm.org.apache.spark.ml

    def begun(array, kind):
        out = context._gateway.new_array(kind, n)
        context._jvm.java.lang.System.arraycopy(array, 0, out, 0, n)  # one call, not one for every tree
        return out

    kind = ml.classification.DecisionTreeClassificationModel if isinstance(model, RandomForestClassificationModel) else ml.regression.DecisionTreeRegressionModel
    trees = begun(own.trees(), kind)
    if isinstance(model, RandomForestClassificationModel):
        return RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(own.uid(), trees, own.numFeatures(), own.numClasses()))
    if isinstance(model, RandomForestRegressionModel):
        return RandomForestRegressionModel(ml.regression.RandomForestRegressionModel(own.uid(), trees, own.numFeatures()))
    weights = begun(own.treeWeights(), context._jvm.double)
    if isinstance(model, GBTClassificationModel):
        return GBTClassificationModel(ml.classification.GBTClassificationModel(own.uid(), trees, weights))
    return GBTRegressionModel(ml.regression.GBTRegressionModel(own.uid(), trees, weights))


def _search(est: Estimator, grid: Sequence[dict], ready: DataFrame, judge: Evaluator) -> Model:
    """The best setting of a grid by the mean over folds. Of boosted models and forests only the longest is fitted per other setting and fold, the shorter ones are its beginnings."""
    rounds = est.maxIter if isinstance(est, (GBTClassifier, GBTRegressor)) else est.numTrees if isinstance(est, (RandomForestClassifier, RandomForestRegressor)) else None
    lengths = sorted({setting[rounds] for setting in grid}) if rounds else [None]
    rest = [{p: v for p, v in setting.items() if p != rounds} for setting in grid]
    others = [o for i, o in enumerate(rest) if o not in rest[:i]]

    def run(job: tuple[int, int]) -> list[float]:
        at, fold = job
        with FITS:
            fitted = est.copy(others[at] | ({rounds: lengths[-1]} if rounds else {})).fit(ready.where(F.col("fold") != fold))
            held = ready.where(F.col("fold") == fold)
            return [judge.evaluate((first_trees(fitted, n) if n else fitted).transform(held)) for n in lengths]

    jobs = [(at, fold) for at in range(len(others)) for fold in range(SEARCH_FOLDS)]
    scores = dict(zip(jobs, side_by_side(ready.sparkSession, run, jobs)))

    def mean(place: int) -> float:
        at, n = others.index(rest[place]), lengths.index(grid[place].get(rounds))
        return sum(scores[at, fold][n] for fold in range(SEARCH_FOLDS)) / SEARCH_FOLDS

    with FITS:
        return est.copy(grid[max(range(len(grid)), key=mean)]).fit(ready)  # the first of equally good settings


def fit(
    train: DataFrame, target: str, columns: Sequence[str], key: str, model: str = "random_forest", preset: str = "default",
    task: str = "classification", classes: Sequence[str] | None = None, trees: int | None = None,
    most_frequent: bool = False,
) -> Fitted:
    """Prepare the columns and fit one model; its trees are Spark's."""
    prepared = prepare(train, target, columns, key, task, classes, most_frequent, preset == "grid_search")
    try:
        return fit_prepared(prepared, model, preset, trees, grown=False)
    finally:
        prepared.release()


# --- protocols -----------------------------------------------------------------------


def judged(predictions: DataFrame, target: str, task: str, by: Sequence[str] = (), digits: int = 4, macro: bool = False) -> DataFrame:
    if task == "classification":
        return evaluation.classification_metrics(predictions, target, "predicted_label", by, digits, macro)
    return evaluation.regression_metrics(predictions, target, "predicted_label", by, digits)


def cross_predictions(df: DataFrame, target: str, columns: Sequence[str], key: str, k: int, **options) -> DataFrame:
    """Out-of-fold predictions of all rows, with their ``fold``."""
    task = options.get("task", "classification")
    split = evaluation.folds(df, key, k, target if task == "classification" else None).persist()
    try:
        parts = []
        for i in range(k):
            fitted = fit(split.where(F.col("fold") != i), target, columns, key, **options)
            part = fitted.predict(split.where(F.col("fold") == i))
            parts.append(part.select(key, target, "fold", "predicted_label"))
        return materialize(reduce(DataFrame.unionByName, parts))
    finally:
        split.unpersist()


CLASS_METRICS = ("accuracy", "f1", "f1_weighted", "precision", "recall")
VALUE_METRICS = ("r2", "mae", "rmse")


@dataclass
class Result:
    candidate_id: str
    status: str = "pending"
    metrics: dict = field(default_factory=dict)
    confusion: list = field(default_factory=list)
    importances: list = field(default_factory=list)
    curve: list = field(default_factory=list)
    error_message: str | None = None


class Bench:
    """The splits of a protocol with their prepared rows, made once for all candidates that see the same columns, and freed together."""

    def __init__(self, df: DataFrame, target: str, key: str, protocol: str, task: str, searched: bool):
        self.df, self.target, self.key, self.protocol, self.task, self.searched = df, target, key, protocol, task, searched
        self.held: list[DataFrame] = []
        self.known: dict[tuple, list[tuple[Prepared, DataFrame]]] = {}
        self.lock = threading.Lock()
        size, by = evaluation.PROTOCOLS[protocol], target if task == "classification" else None
        # plans from here on begin with rows that are kept, not with the reading and numbering of all rows
        if protocol.startswith("holdout"):
            split = self._keep(evaluation.holdout(df, key, size, by))
            self.pairs = [(split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test"))]
        else:
            split = self._keep(evaluation.folds(df, key, size, by))
            self.pairs = [(split.where(F.col("fold") != i), split.where(F.col("fold") == i)) for i in range(size)]

    def _keep(self, df: DataFrame) -> DataFrame:
        kept = cut(df)
        self.held.append(kept)
        return kept

    def columns(self, excluded: Sequence[str]) -> list[str]:
        return preparation.feature_columns(self.df, self.target, [self.key, *excluded])

    def splits(self, excluded: Sequence[str], whole: bool = False) -> list[tuple[Prepared, DataFrame]]:
        """Prepared training rows and test rows (key, target, features) of every split; with ``whole`` all rows as both."""
        wanted = (tuple(excluded), whole)
        def make(pair: tuple[DataFrame, DataFrame]) -> tuple[Prepared, DataFrame]:
            train, test = pair
            found = prepare(train, self.target, self.columns(excluded), self.key, self.task, None, True, self.searched)
            prepared = replace(found, ready=self._keep(found.ready))
            found.release()
            told = [c for c in (self.key, self.target, "fold") if c in test.columns]
            return prepared, self._keep(found.features.transform(test).select(*told, "features"))

        with self.lock:
            if wanted not in self.known:
                self.known[wanted] = side_by_side(self.df.sparkSession, make, [(self.df, self.df)] if whole else self.pairs)
            return self.known[wanted]

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def run_candidate(bench: Bench, candidate: dict, curve_shares: Sequence[float] = ()) -> Result:
    """One candidate under the common protocol; a failure is recorded, not raised."""
    result = Result(candidate["candidate_id"])
    target, task, excluded = bench.target, bench.task, candidate.get("exclude_columns", [])
    classify = task == "classification"
    held: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    try:
        options = dict(model=candidate["model_type"], preset=candidate.get("preset", "default"), trees=candidate.get("trees"))
        if bench.protocol.startswith("holdout"):
            prepared, test = bench.splits(excluded)[0]
            fitted = fit_prepared(prepared, **options)
            tested = kept(fitted.predict_prepared(test, [bench.key, target]))
            metrics = judged(tested, target, task).first().asDict()
            if classify and len(fitted.classes) == 2:
                # a support vector machine has no probabilities but ranks as well by its raw score
                score = F.element_at("probabilities", 2) if "probabilities" in tested.columns else F.col("second_class_score")
                second = tested.select(score.alias("p"), (F.col(target).cast("string") == fitted.classes[1]).cast("int").alias("y"))
                metrics["roc_auc"] = evaluation.roc_auc(second, "p", "y").first()["roc_auc"]
        else:
            pairs = [*bench.splits(excluded), *bench.splits(excluded, whole=True)]
            models = fit_all([prepared for prepared, _ in pairs], **options)
            parts = [model.predict_prepared(test, [bench.key, target, "fold"]).select(bench.key, target, "fold", "predicted_label") for model, (_, test) in zip(models[:-1], pairs)]
            per_fold = judged(kept(reduce(DataFrame.unionByName, parts)), target, task, ["fold"], digits=12, macro=True)
            names = CLASS_METRICS if classify else VALUE_METRICS
            metrics = evaluation.cv_summary(per_fold, names, by=()).first().asDict()
            fitted = models[-1]
            tested = kept(fitted.predict_prepared(pairs[-1][1], [bench.key, target]))
        if classify:
            counts = evaluation.confusion(tested, target, "predicted_label")
            result.confusion = sorted((r["truth"], r["prediction"], r["n"]) for r in counts.collect())  # classes squared
        result.metrics = {k: v for k, v in metrics.items() if v is not None}
        result.importances = fitted.importances(15, 4)
        if curve_shares:
            quick = {**options, "preset": "default", "task": task, "most_frequent": True}
            result.curve = learning_curve(bench.df, target, bench.columns(excluded), bench.key, curve_shares, **quick)
        result.status = "complete"
    except Exception as error:
        result.status, result.error_message = "failed", str(error)[:500]
    finally:
        for df in held:
            df.unpersist()
    return result


def learning_curve(
    df: DataFrame, target: str, columns: Sequence[str], key: str, shares: Sequence[float], k: int = 3, **options
) -> list[tuple[float, float, float]]:
    """Score on training and validation rows for growing, nested parts of the training rows."""
    task = options.get("task", "classification")
    classify = task == "classification"
    metric = "accuracy" if classify else "r2"
    split = cut(evaluation.folds(df, key, k, target if classify else None))
    least = min(1.0, evaluation.LEAST_ROWS / max(1.0, split.count() * (k - 1) / k))
    shares = sorted({max(share, least) for share in shares})
    jobs = [
        (i, share, part) for i in range(k)
        for share, part in preparation.nested_samples(split.where(F.col("fold") != i), key, shares, f"{SEED}|curve")
    ]
    models = side_by_side(df.sparkSession, lambda job: fit(job[2], target, columns, key, **options), jobs)
    parts = []
    for (i, share, part), fitted in zip(jobs, models):
        for kind, rows in (("train", part), ("val", split.where(F.col("fold") == i))):
            told = fitted.predict(rows).select(target, "predicted_label")
            parts.append(told.select("*", F.lit(share).alias("share"), F.lit(i).alias("fold"), F.lit(kind).alias("kind")))
    told = reduce(DataFrame.unionByName, parts)
    scores = judged(told, target, task, ["share", "fold", "kind"])
    of = lambda kind: F.round(F.avg(F.when(F.col("kind") == kind, F.col(metric))), 4)
    curve = scores.groupBy("share").agg(of("train").alias("train"), of("val").alias("val")).orderBy("share")
    found = [tuple(r) for r in curve.collect()]  # one row per share
    split.unpersist()
    return found


RESULTS = """candidate_no int, candidate_id string, status string, accuracy double, f1 double, f1_weighted double,
    precision double, recall double, roc_auc double, accuracy_std double, f1_std double, r2 double, mae double, rmse double,
    mape double, r2_std double, error_message string"""


def run_benchmark(
    df: DataFrame, target: str, key: str, candidates: Sequence[dict], protocol: str, task: str = "classification",
    at_once: int = 4, curve_shares: Sequence[float] = (),
) -> tuple[DataFrame, list[Result]]:
    """All candidates under one protocol, their Spark jobs submitted side by side.

    Splits, features and labels are prepared once for all of them. Every candidate returns its own row, so none can overwrite another's result.
    """
    bench = Bench(df, target, key, protocol, task, any(c.get("preset") == "grid_search" for c in candidates))
    try:
        with ThreadPoolExecutor(max_workers=at_once) as workers:
            run = inheritable_thread_target(df.sparkSession)(lambda candidate: run_candidate(bench, candidate, curve_shares))
            results = list(workers.map(run, candidates))
    finally:
        bench.release()
    names = [part.split()[0] for part in RESULTS.replace("\n", " ").split(", ")]
    rows = []
    for i, r in enumerate(results):
        known = {"candidate_no": i, "candidate_id": r.candidate_id, "status": r.status, "error_message": r.error_message}
        rows.append(tuple(known.get(n, r.metrics.get(n)) for n in names))
    return small_frame(df.sparkSession, rows, RESULTS), results


# --- active learning with models --------------------------------------------------------


def resample_weight(key: str, member: int) -> Column:
    """How often a row occurs in a bootstrap resample: a Poisson(1) count from its draw."""
    u, upto, chance = uniform(key, f"{SEED}|member {member}"), 0.0, float(np.exp(-1.0))
    weight = None
    for count in range(8):
        upto += chance
        weight = F.when(u < upto, float(count)) if weight is None else weight.when(u < upto, float(count))
        chance /= count + 1
    return weight.otherwise(8.0)


def committee_votes(
    labelled: DataFrame, unlabelled: DataFrame, target: str, columns: Sequence[str], key: str, members: int = 3
) -> DataFrame:
    """``key, member, vote`` of shallow trees, each trained on its own resample."""
    classes = preparation.categories(labelled, target, preparation.MAX_INDICATORS) or []
    features = preparation.Features(labelled, columns)
    train = features.transform(labelled).withColumn("label", _labelled(labelled, target, classes))
    train = compact(train, features.rows).persist()
    votes = features.transform(unlabelled)
    for m in range(members):
        weighted = train.withColumn("weight", resample_weight(key, m)).where("weight > 0")
        tree = DecisionTreeClassifier(
            maxDepth=5, seed=m, weightCol="weight", predictionCol=f"vote{m}", rawPredictionCol=f"raw{m}", probabilityCol=f"prob{m}"
        ).fit(weighted)
        votes = tree.transform(votes)
    train.unpersist()
    each = F.array(*[F.struct(F.lit(m).alias("member"), F.col(f"vote{m}").alias("vote")) for m in range(members)])
    return votes.select(key, F.inline(each))


def prediction_variance(
    labelled: DataFrame, unlabelled: DataFrame, target: str, columns: Sequence[str], key: str, members: int = 10
) -> DataFrame:
    """Per row the variance of the predictions of models trained on different resamples."""
    features = preparation.Features(labelled, columns)
    rows = features.rows
    train = compact(features.transform(labelled).withColumn("label", F.col(target).cast("double")), rows).persist()
    out = features.transform(unlabelled)
    for m in range(members):
        weighted = train.withColumn("weight", resample_weight(key, m)).where("weight > 0")
        model = LinearRegression(
            regParam=_penalty(1.0, rows), weightCol="weight", predictionCol=f"p{m}", standardization=False
        ).fit(weighted)
        out = model.transform(out)
    train.unpersist()
    values = F.array(*[F.col(f"p{m}") for m in range(members)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(values) / members
    spread = total(F.transform(values, lambda x: (x - mean) * (x - mean))) / members
    return out.select(key, spread.alias("score"))


def next_batch(
    strategy: str, fitted: Fitted, labelled: DataFrame, unlabelled: DataFrame, target: str, columns: Sequence[str],
    key: str, size: int, round_no: int,
) -> DataFrame:
    """Keys of the rows to label next."""
    if strategy in active.UNCERTAINTY and fitted.task == "classification":
        return active.uncertain_batch(fitted.predict(unlabelled), key, size, strategy).select(key, "score")
    if strategy in active.UNCERTAINTY:
        spread = prediction_variance(labelled, unlabelled, target, columns, key)
        return spread.orderBy(F.col("score").desc(), key).limit(size)
    if strategy == "committee":
        votes = committee_votes(labelled, unlabelled, target, columns, key)
        return active.committee_batch(votes, key, size, 3)
    if strategy == "coreset":
        dense = lambda df: fitted.features.transform(df).select(key, vector_to_array("features").alias("v"))
        picks = active.coreset_batch(dense(unlabelled), dense(labelled), key, "v", size)
        return picks.select(key, F.col("distance").alias("score"))
    return active.random_batch(unlabelled, key, size, round_no).select(key, F.lit(None).cast("double").alias("score"))


@dataclass
class Round:
    metrics: dict
    confusion: list
    importances: list
    batch: DataFrame
    fitted: Fitted
    stop: bool


def run_round(
    df: DataFrame, labels: DataFrame, key: str, target: str, exclude: Sequence[str] = (), model: str = "random_forest",
    strategy: str = "entropy", size: int = 20, task: str = "classification", round_no: int = 1, max_rounds: int = 10,
    target_accuracy: float | None = None, trees: int | None = None,
) -> Round:
    """Train on the labels so far, judge by cross-validation, choose the next rows.

    ``labels(key, label)``; the label replaces the target column.
    """
    columns = preparation.feature_columns(df, target, [key, *exclude])
    assigned = labels.select(F.col(key).alias("__key"), F.col("label").alias(target))
    labelled = df.drop(target).join(assigned, F.col(key) == F.col("__key")).drop("__key").persist()
    unlabelled = active.pool(df.drop(target), labels, key)
    rows = labelled.count()
    if rows == 0:
        raise ValueError("No labels provided yet")
    options = dict(model=model, task=task, trees=trees)
    classify = task == "classification"
    k = min(5, rows)
    several = not classify or labelled.select(target).distinct().limit(2).count() == 2
    if k >= 2 and several:
        out_of_fold = cross_predictions(labelled, target, columns, key, k, **options)
        per_fold = judged(out_of_fold, target, task, ["fold"])
        mean = (
            {"accuracy": "accuracy", "precision": "precision_weighted", "recall": "recall_weighted", "f1": "f1_weighted"}
            if classify else {"mae": "mae", "rmse": "rmse", "r2": "r2"}
        )
        metrics = per_fold.agg(*[F.avg(c).alias(m) for m, c in mean.items()]).first().asDict()
    else:
        metrics = dict.fromkeys(("accuracy", "precision", "recall", "f1") if classify else ("mae", "rmse", "r2"), 0.0)
    fitted = fit(labelled, target, columns, key, **options)
    confusion = []
    if classify and several:
        counts = evaluation.confusion(fitted.predict(labelled), target, "predicted_label")
        confusion = sorted((r["truth"], r["prediction"], r["n"]) for r in counts.collect())  # classes squared
    left = unlabelled.limit(size + 1).count()
    batch = (
        unlabelled.select(key, F.lit(None).cast("double").alias("score")) if left <= size
        else next_batch(strategy, fitted, labelled, unlabelled, target, columns, key, size, round_no)
    )
    stop = active.should_stop(metrics.get("accuracy"), target_accuracy, round_no, max_rounds, left == 0, task)
    return Round(metrics, confusion, fitted.importances(10), batch, fitted, stop)


def batch_rows(df: DataFrame, batch: DataFrame, fitted: Fitted, key: str) -> DataFrame:
    """The rows of a batch with the model's confidence."""
    rows = df.join(batch.select(key), key, "left_semi")
    return _with_confidence(fitted.predict(rows), 1, 4, "confidence")


def predict_all(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Every row with its predicted label as text and the confidence in percent."""
    out = _with_confidence(fitted.predict(df), 100, 1, "prediction_confidence_pct")
    return out.withColumn("predicted_label", F.col("predicted_label").cast("string"))


def _with_confidence(predicted: DataFrame, scale: int, digits: int, name: str) -> DataFrame:
    if "probabilities" not in predicted.columns:
        return predicted
    return predicted.withColumn(name, F.round(F.array_max("probabilities") * scale, digits)).drop("probabilities")
