"""Splits, metrics, winners and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.ranks import number_within, rank_by_draw, running_sum
from sluice.session import small_frame

SEED = 42
PROTOCOLS = {"holdout_80": 0.2, "holdout_90": 0.1, "kfold_5": 5, "kfold_10": 10}
LEARNING_SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)
LEAST_ROWS = 10

# Display names of models and presets.
MODEL_LABELS = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "xgboost": "XGBoost",
    "svm": "SVM",
    "mlp": "Neural Net (MLP)",
}
PRESET_LABELS = {"default": "", "tuned": " (Tuned)", "grid_search": " (Grid Search)"}


# --- data and splits ------------------------------------------------------------


def candidate_source(
    base: DataFrame, target: str, key: str, override: DataFrame | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Rows a candidate is judged on: assigned ``labels(key, label)``, another dataset, or the base.

    Rows without a target are dropped; fewer than ten rows are an error.
    """
    if labels is not None:
        assigned = labels.select(F.col(key).alias("__key"), F.col("label").alias("__label"))
        df = base.drop(target).join(assigned, F.col(key) == F.col("__key")).drop("__key")
        df = df.withColumnRenamed("__label", target)
    else:
        df = base if override is None else override
    df = df.where(F.col(target).isNotNull())
    few = df.limit(LEAST_ROWS).count()
    if few < LEAST_ROWS:
        raise ValueError(f"Too few rows ({few}) after filtering nulls in target")
    return df


def holdout(df: DataFrame, key: str, share: float, target: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: the share of each class (or of all rows) with the lowest draws, rounded up."""
    groups = [target] if target else []
    ranked = rank_by_draw(df, groups, key, seed, "__rank", "__size")
    test = F.col("__rank") <= F.ceil(F.round(F.col("__size") * F.lit(share), 9))
    return ranked.select(*df.columns, test.alias("is_test"))


def folds(df: DataFrame, key: str, k: int, target: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..k-1, of equal size within each class."""
    ranked = rank_by_draw(df, [target] if target else [], key, seed, "__rank")
    return ranked.select(*df.columns, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias("fold"))


# --- classification metrics -------------------------------------------------------


def confusion(df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Rows per true and predicted class."""
    pair = df.groupBy(*by, F.col(truth).cast("string").alias("truth"), F.col(prediction).cast("string").alias("prediction"))
    return pair.agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row per true class and one column per predicted class, zeros included."""
    counts = confusion(df, truth, prediction)
    wide = counts.groupBy("truth").agg(
        *[F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in labels]
    )
    rows = small_frame(df.sparkSession, [(str(c),) for c in labels], "truth string")
    return rows.join(wide, "truth", "left").na.fill(0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per class from confusion counts."""
    seen = F.explode(F.array(
        F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    ))
    hit = F.col("truth") == F.col("prediction")
    tally = counts.select(*by, "n", hit.alias("hit"), seen.alias("s")).groupBy(*by, F.col("s.c").alias("class")).agg(
        F.sum(F.when(F.col("hit") & (F.col("s.t") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.col("s.t") * F.col("n")).alias("support"),
        F.sum(F.col("s.p") * F.col("n")).alias("predicted"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return tally.withColumns({"precision": precision, "recall": recall, "f1": f1})


def classification_metrics(
    df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: Sequence[str] = (), digits: int = 4,
    macro: bool = False,
) -> DataFrame:
    """Accuracy, F1, weighted F1, precision and recall from one grouping.

    With two classes the second one in order is the positive class, unless
    ``macro`` is asked for; else the scores are plain means over classes.
    Undefined ratios count as zero.
    """
    counts = confusion(df, truth, prediction, by)
    per_class = class_scores(counts, by)
    total = F.sum("support")
    weighted = {c: F.sum(F.col(c) * F.col("support")) / total for c in ("f1", "precision", "recall")}
    binary = F.lit(False) if macro else F.count(F.lit(1)) == 2
    pick = lambda c: F.when(binary, F.max_by(c, "class")).otherwise(F.avg(c))
    picked = per_class.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        pick("f1").alias("f1"),
        weighted["f1"].alias("f1_weighted"),
        pick("precision").alias("precision"),
        pick("recall").alias("recall"),
        weighted["precision"].alias("precision_weighted"),
        weighted["recall"].alias("recall_weighted"),
    )
    names = [c for c in picked.columns if c not in by]
    return picked.select(*by, *[F.round(c, digits).alias(c) for c in names])


def roc_auc(df: DataFrame, score: str, positive: str, digits: int = 4) -> DataFrame:
    """The exact area under the ROC curve from ranks; equal scores share their rank.

    Rows are merged per score first. The negatives below each score come from a
    running sum over range partitions.
    """
    merged = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(positive) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(positive) == 1, 0).otherwise(1)).alias("neg"),
    )
    upto = running_sum(merged, ["s"], "neg", "neg_upto")
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    both = F.sum("pos") * F.sum("neg").cast("double")
    return upto.agg(F.round(F.when(both > 0, won / both), digits).alias("roc_auc"))


def regression_metrics(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """R2, mean absolute error, RMSE and MAPE over non-zero targets, in one aggregate."""
    y, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(*by).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var"), F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.when(y != 0, F.abs((y - p) / y))).alias("mape"),
    )
    r2 = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).otherwise(F.lit(0.0))
    return sums.select(
        *by, F.round(r2, digits).alias("r2"), F.round("mae", digits).alias("mae"),
        F.round(F.sqrt("mse"), digits).alias("rmse"), F.round(F.col("mape") * 100, 2).alias("mape"),
    )


def cv_summary(fold_metrics: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Mean and population deviation over the folds of each candidate."""
    return fold_metrics.groupBy(*by).agg(
        *[F.round(F.avg(m), 4).alias(m) for m in metrics],
        *[F.round(F.stddev_pop(m), 4).alias(f"{m}_std") for m in metrics],
    )


# --- winner and leaderboard ----------------------------------------------------------


def candidate_score(task: str) -> Column:
    if task == "classification":
        return F.coalesce("f1", F.lit(0.0)) * 0.6 + F.coalesce("accuracy", F.lit(0.0)) * 0.4
    return F.coalesce("r2", F.lit(-999.0))


def winner(results: DataFrame, task: str, by: Sequence[str] = (), order: str = "candidate_no") -> DataFrame:
    """The complete candidate with the best score; the first in order on a tie."""
    done = results.where(F.col("status") == "complete")
    best = F.max(F.struct(candidate_score(task).alias("score"), (-F.col(order)).alias("first"), F.col("candidate_id").alias("winner")))
    return done.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.winner").alias("winner"), F.col("b.score").alias("score"))


def leaderboard(results: DataFrame, candidates: DataFrame, task: str) -> DataFrame:
    """Complete candidates with their labels, best first, with ranks and the winner's flag.

    ``place`` counts the distinct better scores' rows, as a rank does; it comes
    from a running sum, so any number of candidates may be ranked.
    """
    scored = results.where(F.col("status") == "complete").withColumn("score", candidate_score(task))
    sizes = scored.groupBy("score").agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_sum(sizes, [F.col("score").desc()], "__n", "__upto").select(
        F.col("score").alias("__score"), (F.col("__upto") - F.col("__n") + 1).alias("place")
    )
    best = winner(results, task).select(F.col("winner").alias("__winner"))
    named = candidates.select(F.col("candidate_id").alias("__id"), "label", "model_type", "preset")
    return (
        scored.join(ranks, F.col("score") == F.col("__score"))
        .join(named, F.col("candidate_id") == F.col("__id"))
        .join(F.broadcast(best), F.col("candidate_id") == F.col("__winner"), "left")  # one row
        .select(
            "place", "candidate_id", F.col("label").alias("candidate_label"), "model_type", "preset",
            *[c for c in results.columns if c != "candidate_id"],
            F.when(F.col("__winner").isNotNull(), "yes").otherwise("").alias("is_winner"),
        )
    )


def auto_labels(candidates: DataFrame, order: str) -> DataFrame:
    """Candidates without a label are named by model and preset; repeats get a number."""
    models = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    presets = F.create_map(*[F.lit(x) for pair in PRESET_LABELS.items() for x in pair])
    base = F.concat(
        F.coalesce(models[F.col("model_type")], F.col("model_type")), F.coalesce(presets[F.col("preset")], F.lit(""))
    )
    own = F.trim(F.coalesce("label", F.lit("")))
    blank = candidates.where(own == "").withColumn("__base", base)
    numbered = number_within(blank, ["__base"], [order], "__n")
    text = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit(" #"), F.col("__n").cast("string")))
    named = candidates.where(own != "").withColumn("label", own)
    return named.unionByName(numbered.withColumn("label", text).select(*candidates.columns))
