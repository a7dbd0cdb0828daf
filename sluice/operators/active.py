"""Active learning: which rows to label next."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.ranks import lowest_draws, ordered_index
from sluice.session import materialize, small_frame

SEED = 42
CENTRES_PER_PASS = 5_000  # labelled vectors sent to the tasks at a time
PICKS_PER_CHECKPOINT = 10


def initial_batch(df: DataFrame, key: str, size: int) -> DataFrame:
    return lowest_draws(df, key, SEED, size)


def pool(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows that have no label yet."""
    return df.join(labels.select(key), key, "left_anti").select(*df.columns)


def random_batch(unlabelled: DataFrame, key: str, size: int, round_no: int) -> DataFrame:
    return lowest_draws(unlabelled, key, f"round {round_no}", size)


# --- uncertainty from a probability array ----------------------------------------


def least_confidence(probabilities: Column) -> Column:
    return 1 - F.array_max(probabilities)


def margin(probabilities: Column) -> Column:
    ordered = F.sort_array(probabilities, asc=False)
    return 1 - (F.element_at(ordered, 1) - F.element_at(ordered, 2))


def entropy(probabilities: Column) -> Column:
    return -F.aggregate(probabilities, F.lit(0.0), lambda total, p: total + p * F.log(p + 1e-10))


UNCERTAINTY = {"least_confidence": least_confidence, "margin": margin, "entropy": entropy}


def uncertain_batch(scored: DataFrame, key: str, size: int, strategy: str, probabilities: str = "probabilities") -> DataFrame:
    """The rows the model is least sure of; a top-k, ties by key."""
    score = UNCERTAINTY[strategy](F.col(probabilities))
    return scored.withColumn("score", score).orderBy(F.col("score").desc(), key).limit(size)


def vote_entropy(votes: DataFrame, key: str, members: int) -> DataFrame:
    """Disagreement per row from ``votes(key, member, vote)``: each row has one vote per member."""
    counts = votes.groupBy(key, "vote").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.lit(members)
    return counts.groupBy(key).agg((-F.sum(share * F.log(share))).alias("score"))


def committee_batch(votes: DataFrame, key: str, size: int, members: int) -> DataFrame:
    return vote_entropy(votes, key, members).orderBy(F.col("score").desc(), key).limit(size)


# --- greedy k-centre ---------------------------------------------------------------


def unit_length(vector: Column) -> Column:
    """A vector of doubles with length 1; a zero vector stays zero."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda total, x: total + x * x))
    return F.when(length > 0, F.transform(doubles, lambda x: x / length)).otherwise(doubles)


def _nearest(df: DataFrame, centres: Sequence[Sequence[float]], into: str) -> DataFrame:
    """Lower ``into`` to the distance from the nearest of ``centres``, batch by batch in numpy."""
    context = df.sparkSession.sparkContext
    shared = context.broadcast(np.asarray(centres, dtype=np.float64))

    @F.pandas_udf("double")
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        points = shared.value
        squares = (points**2).sum(axis=1)
        for batch in batches:
            rows = np.vstack(batch.to_numpy()) if len(batch) else np.zeros((0, points.shape[1]))
            best = np.full(len(rows), np.inf)
            for at in range(0, len(points), 512):
                part = points[at : at + 512]
                gap = (rows**2).sum(axis=1)[:, None] - 2 * rows @ part.T + squares[at : at + 512][None, :]
                best = np.minimum(best, gap.min(axis=1))
            yield pd.Series(np.sqrt(np.maximum(best, 0.0)))

    found = distance(F.col("__unit"))
    return df.withColumn(into, F.least(F.col(into), found) if into in df.columns else found)


def _gap(centre: Sequence[float]) -> Column:
    """Distance to one centre, inside code generation."""
    pairs = F.zip_with("__unit", F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x))


def coreset_batch(unlabelled: DataFrame, labelled: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Repeatedly take the row farthest from everything labelled or taken so far.

    Each row keeps its distance to the nearest centre, so a pick is one maximum
    over the table and the update one distance per row. Labelled vectors reach
    the tasks in blocks of bounded size. Ties go to the smallest key.
    """
    state = unlabelled.select(key, unit_length(F.col(vector)).alias("__unit"))
    known = materialize(labelled.select(F.monotonically_increasing_id().alias("__n"), unit_length(F.col(vector)).alias("u")))
    total = known.count()
    if total == 0:
        raise ValueError("coreset needs at least one labelled row")
    blocks = known.withColumn("__block", F.lit(0)) if total <= CENTRES_PER_PASS else _numbered_blocks(known, total)
    for block in range((total + CENTRES_PER_PASS - 1) // CENTRES_PER_PASS):
        centres = [r["u"] for r in blocks.where(F.col("__block") == block).select("u").collect()]  # bounded block
        state = _nearest(state, centres, "__gap")
        if block % PICKS_PER_CHECKPOINT == PICKS_PER_CHECKPOINT - 1:
            state = materialize(state)
    state = materialize(state)
    picks: list[tuple] = []
    for place in range(size):
        best = state.agg(F.max(F.struct("__gap", (-F.col(key)).alias("k"), "__unit")).alias("b")).first()["b"]
        if best is None or best["__gap"] is None:
            break
        picks.append((place + 1, -best["k"], float(best["__gap"])))
        state = state.where(F.col(key) != F.lit(-best["k"])).withColumn("__gap", F.least("__gap", _gap(best["__unit"])))
        if place % PICKS_PER_CHECKPOINT == PICKS_PER_CHECKPOINT - 1:
            state = materialize(state)
    return small_frame(unlabelled.sparkSession, picks, f"pick int, {key} bigint, distance double")


def _numbered_blocks(known: DataFrame, total: int) -> DataFrame:
    return ordered_index(known, ["__n"], "__at").withColumn("__block", F.floor(F.col("__at") / CENTRES_PER_PASS))


# --- rounds ------------------------------------------------------------------------


def round_deltas(rounds: DataFrame, metric: str = "accuracy", session: str = "session_id", number: str = "round") -> DataFrame:
    """Each round with the round before; rounds are numbered without gaps, so this is an equi-join."""
    before = rounds.select(
        F.col(session).alias("__s"), (F.col(number) + 1).alias("__r"), F.col(metric).alias(f"previous_{metric}")
    )
    same = (F.col(session) == F.col("__s")) & (F.col(number) == F.col("__r"))
    joined = rounds.join(before, same, "left").drop("__s", "__r")
    return joined.withColumn(f"{metric}_delta", F.col(metric) - F.col(f"previous_{metric}"))


def should_stop(
    accuracy: float | None, target_accuracy: float | None, round_no: int, max_rounds: int, batch_empty: bool,
    task: str = "classification",
) -> bool:
    reached = task == "classification" and bool(target_accuracy) and (accuracy or 0.0) >= target_accuracy
    return reached or round_no >= max_rounds or batch_empty


def export_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labelled rows with the label they were given, in key order."""
    assigned = labels.select(F.col(key).alias("__key"), F.col("label").alias("assigned_label"))
    return df.join(assigned, F.col(key) == F.col("__key")).drop("__key").orderBy(key)


# --- scoring ---------------------------------------------------------------------------


def title_case(text: Column) -> Column:
    """Upper first letter after every non-letter, lower letters elsewhere."""
    words = F.split(text, r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), ""
    )


def normalized(df: DataFrame, titled: Sequence[str] = (), lowered: Sequence[str] = ()) -> DataFrame:
    return df.withColumns(
        {c: F.trim(title_case(F.col(c))) for c in titled} | {c: F.trim(F.lower(c)) for c in lowered}
    )


def scored_rows(df: DataFrame, probability: str, threshold: float = 0.5) -> DataFrame:
    """Probability (three decimals), yes or no, and the risk band."""
    p = F.col(probability)
    band = F.when(p >= 0.6, "HIGH").when(p >= 0.35, "MEDIUM").otherwise("LOW")
    return df.withColumns(
        {
            "prediction": F.when(p >= threshold, "yes").otherwise("no"), "risk_level": band,
            probability: F.round(p, 3),
        }
    )


def scoring_summary(scored: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("prediction") == "yes")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), flagged.alias("at_risk"),
        F.round(flagged / F.count(F.lit(1)) * 100, 1).alias("at_risk_pct"),
    )


def riskiest(scored: DataFrame, probability: str, key: str, rows: int = 10) -> DataFrame:
    return scored.orderBy(F.col(probability).desc(), key).limit(rows)

