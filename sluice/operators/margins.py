"""Linear support vector machines fitted together: one Spark job evaluates the losses of all that still move."""

from __future__ import annotations

import sys
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4_096
REDUCED_AT_ONCE = 64  # partitions whose sums meet in one step; more meet in two
WIDEST = 512  # features; wider rows are mostly zeros and are better kept as sparse vectors
MEMORY = 10  # steps that shape the next one
TRIES = 25  # lengths tried along a direction

register_pickle_by_value(sys.modules[__name__])  # executors need not find this package


@dataclass(frozen=True)
class Wanted:
    """A machine: its rows are those of ``part`` but for the ``without`` fold (None: all of them)."""

    part: int
    without: int | None
    penalty: float


def _packed(part: int) -> Callable:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                cut = batch.slice(start, BLOCK_ROWS)
                x = np.asarray(cut.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
                y = np.asarray(cut.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)  # null: NaN
                fold = np.asarray(cut.column(2).to_numpy(zero_copy_only=False), dtype=np.int32)
                cells = [[part], [x.tobytes()], [y.tobytes()], [fold.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "x", "y", "fold"])

    return pack


def _unpacked(row) -> tuple:
    y = np.frombuffer(row["y"])
    return row["part"], np.frombuffer(row["x"]).reshape(len(y), -1), y, np.frombuffer(row["fold"], np.int32)


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a | b}


class Together:
    """The rows of several parts (``features, label`` and, if there are folds, ``fold``) as kept blocks."""

    def __init__(self, parts: Sequence[DataFrame]):
        spark = parts[0].sparkSession
        blocks = []
        for i, part in enumerate(parts):
            fold = F.col("fold").cast("int") if "fold" in part.columns else F.lit(-1)
            cells = part.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), fold.alias("fold"))
            blocks.append(cells.mapInArrow(_packed(i), "part int, x binary, y binary, fold binary").rdd.map(_unpacked))
        self.blocks: RDD = spark.sparkContext.union(blocks).persist(StorageLevel.MEMORY_AND_DISK)
        self.width = self.blocks.getNumPartitions()

    def release(self) -> None:
        self.blocks.unpersist()

    def _sums(self, of: Callable, asked: dict[int, tuple]) -> dict:
        """The sums of ``of(x, y, fold, *asked[part])`` over the blocks of each part."""

        def local(rows: Iterable[tuple]) -> Iterator[dict]:
            total: dict = {}
            for part, x, y, fold in rows:
                if part in asked:
                    total = _added(total, {part: of(x, y, fold, *asked[part])})
            yield total

        sums = self.blocks.mapPartitions(local)
        return sums.reduce(_added) if self.width <= REDUCED_AT_ONCE else sums.treeReduce(_added)

    @staticmethod
    def _by_part(wanted: Sequence[Wanted], points: dict[int, np.ndarray] | None = None) -> dict[int, tuple]:
        """Per part the left-out folds of its machines, in their order, and their points as columns."""
        out = {}
        for part in sorted({wanted[i].part for i in (range(len(wanted)) if points is None else points)}):
            own = [i for i, w in enumerate(wanted) if w.part == part and (points is None or i in points)]
            left = np.array([-2 if wanted[i].without is None else wanted[i].without for i in own], dtype=np.int32)
            out[part] = (left, np.stack([points[i] for i in own], axis=1)) if points is not None else (left,)
        return out

    def _spread(self, wanted: Sequence[Wanted], asked: dict[int, tuple], sums: dict) -> list:
        """The columns of each part's sums, dealt to their machines."""
        at = dict.fromkeys(asked, 0)
        out = []
        for w in wanted:
            found = sums.get(w.part)
            out.append(None if found is None else found[:, at[w.part]])
            at[w.part] += 1
        return out

    def fit(self, wanted: Sequence[Wanted], rounds: int, tolerance: float) -> list[np.ndarray] | None:
        """Per machine its coefficients with the intercept last, or None if a machine has no rows or a row has no finite features or no label of 0 or 1.

        The mean hinge loss plus half the penalty times the squared coefficients, as in Spark's ``LinearSVC`` without
        standardization. Steps are taken in units of each feature's deviation; constant features get no coefficient.
        """
        asked = self._by_part(wanted)
        facts = self._spread(wanted, asked, self._sums(_moments, asked))
        if any(f is None or f[0] == 0 or f[1] > 0 for f in facts):
            return None
        counts, units = [], []
        for f in facts:
            n, width = f[0], (len(f) - 2) // 2
            mean, square = f[2 : 2 + width] / n, f[2 + width :] / n
            variance = square - mean**2
            variance[variance <= 1e-12 * square] = 0.0
            counts.append(n)
            units.append(np.sqrt(variance * n / max(n - 1, 1)))
        scales = [np.append(np.divide(1.0, u, out=np.zeros_like(u), where=u > 0), 1.0) for u in units]
        walks = [descent(np.zeros(len(s)), rounds, tolerance) for s in scales]
        best: list[np.ndarray | None] = [None] * len(wanted)
        points = {i: next(walk) for i, walk in enumerate(walks)}
        while points:
            moving = sorted(points)
            asked = self._by_part(wanted, {i: points[i] * scales[i] for i in moving})
            told = self._spread([wanted[i] for i in moving], asked, self._sums(_losses, asked))
            ahead = {}
            for i, sums in zip(moving, told):
                weights = (points[i] * scales[i])[:-1]
                value = sums[0] / counts[i] + wanted[i].penalty / 2 * float(weights @ weights)
                slope = sums[1:] / counts[i]
                slope[:-1] += wanted[i].penalty * weights
                try:
                    ahead[i] = walks[i].send((value, slope * scales[i]))
                except StopIteration as end:
                    best[i] = end.value * scales[i]
            points = ahead
        return best

    def accuracies(self, wanted: Sequence[Wanted], machines: Sequence[np.ndarray]) -> list[float]:
        """The share of right predictions of each machine on the rows of its left-out fold; NaN without such rows."""
        asked = self._by_part(wanted, dict(enumerate(machines)))
        told = self._spread(wanted, asked, self._sums(_hits, asked))
        return [float(t[1] / t[0]) if t[0] else float("nan") for t in told]


def _moments(x: np.ndarray, y: np.ndarray, fold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Per machine its rows, its unusable rows, and the sums and squared sums of the features."""
    used = (fold[:, None] != left[None, :]).astype(np.float64)
    good = np.isfinite(x).all(axis=1) & ((y == 0) | (y == 1))
    x = np.where(good[:, None], x, 0.0)
    return np.vstack([used.sum(axis=0), (used * ~good[:, None]).sum(axis=0), x.T @ used, (x * x).T @ used])


def _losses(x: np.ndarray, y: np.ndarray, fold: np.ndarray, left: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per machine the sum of hinge losses at its point and their slope."""
    side = (2 * y - 1)[:, None]
    slack = 1 - side * (x @ at[:-1] + at[-1])
    short = (slack > 0) & (fold[:, None] != left[None, :])
    pull = -side * short
    return np.vstack([(slack * short).sum(axis=0), x.T @ pull, pull.sum(axis=0)])


def _hits(x: np.ndarray, y: np.ndarray, fold: np.ndarray, left: np.ndarray, at: np.ndarray) -> np.ndarray:
    held = fold[:, None] == left[None, :]
    right = held & ((x @ at[:-1] + at[-1] > 0) == (y == 1)[:, None])
    return np.vstack([held.sum(axis=0), right.sum(axis=0)]).astype(np.float64)


def descent(start: np.ndarray, rounds: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with bisected steps, which also descends losses with kinks: yields points, is sent value and slope there, returns the best point.

    Ends after ``rounds`` steps, when ``MEMORY`` steps together lower the value by no more than its share ``tolerance``, or when no step lowers it.
    """
    x, steps, values = start, [], []
    value, slope = yield x
    for _ in range(rounds):
        values.append(value)
        if len(values) > MEMORY and values[-MEMORY - 1] - value <= tolerance * abs(value):
            break
        direction, pulls = -slope, []
        for s, g in reversed(steps):
            pulls.append(float(s @ direction) / float(s @ g))
            direction = direction - pulls[-1] * g
        if steps:
            s, g = steps[-1]
            direction = direction * (float(s @ g) / float(g @ g))
        for (s, g), pull in zip(steps, reversed(pulls)):
            direction = direction + s * (pull - float(g @ direction) / float(s @ g))
        fall = float(direction @ slope)
        if not fall < 0:
            direction, steps, fall = -slope, [], -float(slope @ slope)
            if fall == 0:
                break
        low, high, length, found = 0.0, np.inf, 1.0 if steps else min(1.0, 1.0 / np.sqrt(-fall)), None
        for _ in range(TRIES):
            there = x + length * direction
            now, lean = yield there
            if not now <= value + 1e-4 * length * fall:
                high = length
            else:
                if found is None or now < found[1]:
                    found = there, now, lean
                if float(lean @ direction) >= 0.9 * fall:
                    found = there, now, lean
                    break
                low = length
            length = (low + high) / 2 if np.isfinite(high) else 2 * low
        if found is None or not found[1] < value:
            if not steps:
                break
            steps = []  # once more along the slope itself
            continue
        there, now, lean = found
        s, g = there - x, lean - slope
        if float(s @ g) > 1e-12 * float(g @ g):
            steps = [*steps, (s, g)][-MEMORY:]
        x, value, slope = there, now, lean
    return x
