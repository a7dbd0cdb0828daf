"""Labels that are probably wrong, by confident learning on out-of-fold probabilities.

A class's threshold is the mean probability that its own rows give it. A row
speaks for the most probable class among those whose threshold it reaches; if
that is not its label, the label is an issue. The confident joint counts labels
against what rows speak for, scaled to the size of each class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import evaluation, models, preparation
from sluice.session import materialize


def out_of_fold(df: DataFrame, target: str, columns: Sequence[str], key: str, k: int = 5, model: str = "logistic_regression", **options) -> tuple[DataFrame, list[str]]:
    """``key``, ``target`` and ``probabilities`` of all labelled rows, each from a model that has not seen the row; and the classes they are of."""
    known = df.where(F.col(target).isNotNull())
    classes = preparation.categories(known, target, preparation.MAX_INDICATORS)
    if not classes or len(classes) < 2:
        raise ValueError(f"{target} needs two classes or more, and {preparation.MAX_INDICATORS} at most")
    split = evaluation.folds(known, key, k, target).persist()
    parts = []
    try:
        for i in range(k):
            fitted = models.fit(split.where(F.col("fold") != i), target, columns, key, model=model, classes=classes, **options)
            parts.append(fitted.predict(split.where(F.col("fold") == i)).select(key, target, "probabilities"))
        return materialize(reduce(DataFrame.unionByName, parts)), list(classes)
    finally:
        split.unpersist()


def thresholds(df: DataFrame, label: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    """One row: ``thresholds``, an array of every class's mean self-confidence; null for a class without rows."""
    given = F.col(label).cast("string")
    own = [F.avg(F.when(given == c, F.col(probabilities)[i])) for i, c in enumerate(classes)]
    return df.agg(F.array(*own).alias("thresholds"))


def judged_labels(df: DataFrame, label: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    """``df`` with ``suggested`` (the class a row speaks for, null if it reaches no threshold), ``self_confidence`` and ``is_issue``.

    Two passes: one aggregate for the thresholds, one projection. Ties go to the class named first.
    Rows without a label are no issue.
    """
    names = F.array(*[F.lit(c) for c in classes])
    limits = F.col("__limits")  # a subquery cannot stand inside the function over the classes
    marks = F.transform(
        F.col(probabilities),
        lambda p, i: F.when(p >= limits[i], F.struct(p.alias("p"), (-i).alias("i"), names[i].alias("class"))),
    )
    best = F.array_max(F.array_compact(marks))
    place = F.array_position(names, F.col(label).cast("string")).cast("int")
    own = F.when(place > 0, F.get(probabilities, place - 1))
    limited = df.withColumn("__limits", thresholds(df, label, probabilities, classes).scalar())
    return limited.withColumns(
        {
            "suggested": best["class"],
            "self_confidence": own,
            "is_issue": F.coalesce(best["class"] != F.col(label).cast("string"), F.lit(False)),
        }
    ).drop("__limits")


def ranked_issues(judged: DataFrame, key: str, label: str, limit: int | None = None) -> DataFrame:
    """The issues, least self-confident first; ``limit`` keeps the worst."""
    issues = judged.where("is_issue").select(key, F.col(label).cast("string").alias("label"), "suggested", "self_confidence")
    return issues if limit is None else issues.orderBy("self_confidence", key).limit(limit)


def confident_joint(judged: DataFrame, label: str) -> DataFrame:
    """``given``, ``suggested``, ``n``, and ``share``: how much of the whole table each pair of label and class makes up.

    Counts are scaled so that each label has as many rows as it does in the
    table. A label whose rows reach no threshold is taken at its word. One row
    per pair of classes.
    """
    given = F.col(label).cast("string").alias("given")
    counts = judged.where(F.col(label).isNotNull()).groupBy(given, "suggested").agg(F.count(F.lit(1)).alias("n"))
    per_label = Window.partitionBy("given")
    whole = Window.partitionBy(F.lit(0))
    sized = counts.withColumns({"__size": F.sum("n").over(per_label), "__sure": F.sum(F.when(F.col("suggested").isNotNull(), F.col("n"))).over(per_label)})
    scaled = sized.where(F.col("suggested").isNotNull() | F.col("__sure").isNull()).select(
        "given", F.coalesce("suggested", "given").alias("suggested"), "n", (F.col("n") / F.coalesce("__sure", "__size") * F.col("__size")).alias("__scaled")
    )
    return scaled.select("given", "suggested", "n", F.round(F.col("__scaled") / F.sum("__scaled").over(whole), 6).alias("share"))


def noise_rates(joint: DataFrame) -> DataFrame:
    """Per label its share of the table and of rows that speak for another class."""
    total = F.sum("share")
    wrong = F.sum(F.when(F.col("given") != F.col("suggested"), F.col("share")).otherwise(0.0))
    return joint.groupBy(F.col("given").alias("label")).agg(F.round(total, 4).alias("share"), F.round(wrong / total, 4).alias("noise_rate"))


def label_issues(df: DataFrame, target: str, columns: Sequence[str], key: str, k: int = 5, **options) -> DataFrame:
    """All rows that have a label, judged by models trained on the other folds."""
    told, classes = out_of_fold(df, target, columns, key, k, **options)
    return judged_labels(told, target, "probabilities", classes)

