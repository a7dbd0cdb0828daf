"""Toxicity scores by weak supervision.

Features of a text are its distinct words (letters, digits, non-ASCII; A-Z as
a-z) and their beginnings of 4, 5 and 6 bytes, as hashes.

1. *Voters.* Of the features of a bounded sample of labelled rows, all that speak
   for the label become voters: lexicon voters are words, pattern voters are
   beginnings. Features that occur in the same labelled texts are one voter, which
   fires on a text that has any of them.
2. *Label model.* Which voters fire together is counted over all rows that may
   be learnt from, as one count per pattern of votes. A mixture of two classes is
   fitted to these counts by expectation maximisation: how often each voter
   fires in each class (its accuracy) and, from the pairs that fire together more
   often than the classes explain, how correlated the voters are; a voter's
   evidence is divided among those it repeats.
3. *Classifier.* A sparse logistic regression over all hashed features is trained
   on the posteriors of a bounded sample of rows, and scores every text.

The bounds are ``LABELLED_ROWS`` and ``TRAIN_ROWS``; counts of votes and scores
cover all rows and whole texts. Learning leaves out the rows that are held out by
their key, and rows without a key.

Null and empty texts have no features and get the score of the intercept. Rows
that repeat a key are rows of their own; a key with several labels counts as
toxic if one says so. Without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.draws import wide_draw
from sluice.llm import texts as X

LABELLED_ROWS = 8192
TRAIN_ROWS = 4096
PATTERNS = 1024  # patterns of votes spread out at once
LEAST = 4  # texts of the label in which a voter's feature must occur
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6)
ROUNDS = 12
STEPS = 400


def features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features, with repeats, and the text each is of; one block of words and one per length of beginning."""
    starts, ends, first = X.words(body, at, X.ALNUM)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    prefix = X.sums(body, X.FOLDED)
    hashes, of = [X.spans_hash(prefix, starts, ends)], [text]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= k)
        hashes.append(X.spans_hash(prefix, starts[long], starts[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        of.append(text[long])
    return np.concatenate(hashes), np.concatenate(of)


def _distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once per text, by text and hash."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], text[keep]


class Lookup:
    """Which of a few hashes is met: a table of places, then an exact comparison."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.sorted >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are met, and the number of the hash met there."""
        maybe = np.flatnonzero(self.flags[h >> np.uint64(48)])
        spot = np.minimum(np.searchsorted(self.sorted, h[maybe]), max(len(self.sorted) - 1, 0))
        right = self.sorted[spot] == h[maybe] if len(self.sorted) else np.zeros(0, bool)
        return maybe[right], self.order[spot[right]]


def _sample(rows: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """The ``size`` keys with the smallest draws."""
    return rows.withColumn("__draw", wide_draw(key, seed)).orderBy("__draw", key).limit(size).drop("__draw")


def mine(texts: DataFrame) -> tuple[Voters, LabelModel] | None:
    """The voters and what the labelled rows ``key``, ``text``, ``toxic`` say of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            toxic, low, high = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "low", "high"))
            h, text = _distinct(*features(body, at))
            h = np.concatenate((h, np.zeros(len(toxic), np.uint64)))  # hash 0 counts the texts
            text = np.concatenate((text, np.arange(len(toxic))))
            value, spot = np.unique(h, return_inverse=True)
            summed = (np.bincount(spot, x[text], len(value)) for x in (toxic, np.ones(len(toxic)), low, high))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in summed)], names=["h", *counts])

    counts = ["yes", "n", "low", "high"]
    row = F.xxhash64("key", "text")  # its halves are summed over the texts of a feature: equal sums, equal texts
    halves = texts.select("text", "toxic", row.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned(row, 32).alias("high"))
    table = halves.mapInArrow(count, X.schema("h bigint, yes bigint, n bigint, low bigint, high bigint")).groupBy("h").agg(*[F.sum(c).alias(c) for c in counts])
    whole = F.col("h") == 0
    strong = (F.col("yes") >= LEAST) & (5 * F.col("yes") >= 4 * F.col("n"))  # right four times in five
    # a word and its beginnings that occur in the same texts say the same: they are one voter
    found = table.where(whole | strong).groupBy(whole.alias("whole"), *counts).agg(F.sort_array(F.collect_list("h")).alias("h")).collect()
    total = next((r for r in found if r["whole"]), None)
    chosen = sorted((r for r in found if not r["whole"]), key=lambda r: (-r["yes"] * r["yes"] / r["n"], r["h"]))
    if total is None or not 0 < total["yes"] < total["n"] or not chosen:
        return None
    yes, n = (np.array([r[c] for r in chosen], np.int64) for c in ("yes", "n"))
    return Voters([np.array(r["h"], np.int64).view(np.uint64) for r in chosen]), LabelModel(yes, n, total["yes"], total["n"])


class Voters:
    """Every voter's features; a voter fires on a text that has one of them."""

    def __init__(self, features: list[np.ndarray]):
        self.lookup = Lookup(np.concatenate(features))
        self.of, self.n = np.repeat(np.arange(len(features)), [len(x) for x in features]), len(features)

    def masks(self, h: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """The voters that fire on each text, as bits in as many bytes as they need."""
        spot, feature = self.lookup.find(h)
        fired = np.zeros((texts, self.n), bool)
        fired[text[spot], self.of[feature]] = True
        return np.packbits(fired, axis=1, bitorder="little")


def votes(df: DataFrame, voters: Voters) -> DataFrame:
    """``key`` and the voters that fire on the text as the bits of ``votes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            masks = voters.masks(*features(body, at), len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([m.tobytes() for m in masks], pa.binary())], names=["key", "votes"])

    return df.mapInArrow(run, X.schema("key bigint, votes binary"))


class LabelModel:
    """How often each voter fires in each class, and which voters repeat each other.

    The labelled rows count as rows whose class is known, together as many as
    the others; they keep the two classes what they are meant to be.
    """

    def __init__(self, yes: np.ndarray, n: np.ndarray, texts_yes: float, texts: float):
        self.prior = np.array([(n - yes) / (texts - texts_yes), yes / texts_yes])
        self.prior_share = self.share = texts_yes / texts
        self.fires = np.clip(self.prior, 1e-4, 0.999)
        self.together = np.eye(len(yes))  # correlation of voters within the class of the label

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        fired = self._fired(masks)
        gain, loss = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        repeated = fired @ self.together  # how many of the voters that fire say the same as each
        odds = np.log(self.share / (1 - self.share)) + (fired * gain / np.maximum(repeated, 1)).sum(axis=1)
        odds += (1 - fired) @ (loss / self.together.sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def _fired(self, masks: np.ndarray) -> np.ndarray:
        return np.unpackbits(masks, axis=1, count=len(self.together), bitorder="little").astype(float)

    def moments(self, masks: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each class the texts, then how often each pair of voters fires (a voter with itself: alone)."""
        fired, p = self._fired(masks), self.posterior(masks)
        return np.array([np.concatenate(([w.sum()], ((fired * w[:, None]).T @ fired).ravel())) for w in (n * (1 - p), n * p)])

    def update(self, moments: np.ndarray) -> None:
        v = len(self.together)
        texts = moments[:, 0]
        pairs = moments[:, 1:].reshape(2, v, v)
        single = np.diagonal(pairs, axis1=1, axis2=2)
        known = texts.sum() * np.array([1 - self.prior_share, self.prior_share])
        self.share = float(np.clip((texts[1] + known[1]) / (2 * texts.sum()), 0.001, 0.9))
        self.fires = np.clip((single + known[:, None] * self.prior) / (texts + known)[:, None], 1e-4, 0.999)
        mean = single[1] / max(texts[1], 1e-9)
        spread = np.sqrt(np.outer(mean * (1 - mean), mean * (1 - mean)))
        self.together = np.clip((pairs[1] / max(texts[1], 1e-9) - np.outer(mean, mean)) / np.maximum(spread, 1e-9), 0, 1)
        np.fill_diagonal(self.together, 1.0)


def label_model(patterns: DataFrame, model: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    """``model`` fitted to ``patterns(votes, n)``, which must be cheap to read again. Each round sums over all of it in parallel."""
    voters = len(model.together)
    for _ in range(rounds):
        held = model

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 1 + voters * voters))
            for batch in batches:
                n = batch.column("n").to_numpy(zero_copy_only=False)
                for low in range(0, len(n), PATTERNS):
                    part = batch.column("votes").slice(low, PATTERNS).to_pylist()
                    total += held.moments(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1), n[low : low + PATTERNS])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = patterns.mapInArrow(sums, X.schema("sums binary")).collect()  # one fixed-size row per partition of the patterns
        model.update(sum(np.frombuffer(r["sums"]).reshape(2, -1) for r in parts))
    return model


def _screened(h: np.ndarray, text: np.ndarray, target: np.ndarray, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that go with the target beyond chance: hashes, and the entries of their columns."""
    value, column, count = np.unique(h, return_inverse=True, return_counts=True)
    base = float(target.mean())
    beyond = np.abs(np.bincount(column, target[text]) - count * base) / np.sqrt(count * base * (1 - base))
    beyond[count < 3] = 0
    chosen = np.argsort(-beyond, kind="stable")[:most]
    chosen = np.sort(chosen[beyond[chosen] >= 4])
    number = np.full(len(value), -1)
    number[chosen] = np.arange(len(chosen))
    column = number[column]
    keep = np.flatnonzero(column >= 0)
    return value[chosen], column[keep], text[keep]


def _train(h: np.ndarray, text: np.ndarray, target: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse logistic regression by accelerated proximal gradient: the features that keep a weight, their weights, the intercept."""
    value, column, row = _screened(h, text, target)
    n, width = len(target), len(value)
    direction = np.ones(width)
    most = 1.0
    for _ in range(20):  # the largest eigenvalue bounds the step
        direction = np.bincount(column, np.bincount(row, direction[column], n)[row], width)
        most = float(np.sqrt((direction**2).sum())) if width else 1.0
        direction /= max(most, 1e-12)
    step = 4 * n / (1.1 * most + n)
    base = target.mean()
    weights, bias = np.zeros(width), float(np.log(base / (1 - base)))
    ahead, ahead_bias, momentum = weights, bias, 1.0
    for _ in range(STEPS):
        odds = np.bincount(row, ahead[column], n) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - target) / n
        moved = ahead - step * np.bincount(column, error[row], width)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_bias = ahead_bias - step * float(error.sum())
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / after
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias, momentum = new, new_bias, after
    kept = np.flatnonzero(weights)
    return value[kept], weights[kept], float(bias)


class Classifier:
    """Linear in the features of a text, each counted once."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.lookup, self.weights, self.bias = Lookup(hashes), weights, bias

    def score(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        h, text = features(body, at)
        spot, number = self.lookup.find(h)
        pair = np.unique(text[spot] * np.int64(len(self.weights) + 1) + number)
        odds = self.bias + np.bincount(pair // (len(self.weights) + 1), self.weights[pair % (len(self.weights) + 1)], len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic", labelled_rows: int = LABELLED_ROWS, train_rows: int = TRAIN_ROWS) -> Classifier | None:
    """A classifier learnt from the rows of ``df`` that are not held out."""
    docs = X.prepared(df, key, text).where(F.col("key").isNotNull() & ~X.held_out(F.col("key")))
    known = (
        labels.select(F.col(label_key).cast("long").alias("key"), F.col(label).cast("int").alias("toxic"))
        .where(F.col("key").isNotNull() & ~X.held_out(F.col("key")) & F.col("toxic").isin(0, 1))
        .groupBy("key")
        .agg(F.max("toxic").alias("toxic"))
    )
    sampled = _sample(known, "key", "labels", labelled_rows)
    mined = mine(docs.join(F.broadcast(sampled), "key").select("key", "text", "toxic"))  # labelled_rows rows
    if mined is None:
        return None
    voters, model = mined
    fired = votes(docs, voters)
    patterns = X.written(fired.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    model = label_model(patterns, model)
    labelled = _sample(sampled, "key", "labels", train_rows)
    chosen = _sample(docs.select("key").distinct(), "key", "train", train_rows).union(labelled.select("key")).distinct()
    rows = docs.join(F.broadcast(chosen), "key", "left_semi")  # at most 2 * train_rows keys

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts, targets, n = [], [], [], 0
        for batch, body, at in X.steps(batches):
            h, of = features(body, at)
            masks = voters.masks(h, of, len(at) - 1)
            h, of = _distinct(h, of)
            hashes.append(h)
            texts.append((of + n).astype(np.int32))
            targets.append(model.posterior(masks))
            n += len(masks)
        if not n:
            return
        found, weights, bias = _train(np.concatenate(hashes), np.concatenate(texts), np.clip(np.concatenate(targets), 1e-4, 1 - 1e-4))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["hashes", "weights", "bias"])

    # the bounded sample meets in one task, which returns weights only
    fitted = rows.repartition(1).mapInArrow(learn, X.schema("hashes binary, weights binary, bias double")).first()
    return None if fitted is None else Classifier(np.frombuffer(fitted["hashes"], np.uint64), np.frombuffer(fitted["weights"]), fitted["bias"])


def score(df: DataFrame, model: Classifier | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            found = np.zeros(len(at) - 1) if model is None else model.score(body, at)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], names=["key", "score"])

    return X.prepared(df, key, text).mapInArrow(run, X.schema("key bigint, score double"))
