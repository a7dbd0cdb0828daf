"""Boosted trees and forests grown side by side: a task grows the trees of one fit from binned rows, in numpy.

Trees are those of Spark ML: at most 32 bins a feature with thresholds by Spark's rule, levels split by the largest gain,
rounds of boosting on the slope of the loss, forests on Poisson resamples with some features per node. Rows that fall into
the same bins and have the same label are one row with a weight.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
SAMPLED_ROWS = 10_000  # rows that Spark looks at for thresholds, of more it draws as many
BLOCK_ROWS = 65_536
LARGEST = 1 << 30  # bytes that the rows of one fit may take in a task; larger ones are left to Spark's estimators
WIDEST = 512  # features
TREES_AT_ONCE = 50  # trees of a forest that a task grows
DRAWN_AT_ONCE = 1 << 20  # rows of a resample
CELLS = 1 << 22  # sums kept at once while a level is split
NOISE = 1e-12  # gains below this share of the impurity come from rounding

register_pickle_by_value(sys.modules[__name__])  # executors need not find this package


@dataclass(frozen=True)
class Wanted:
    """A fit: its rows are those of ``part`` but for the ``without`` fold (None: all of them), which its scores are taken on."""

    part: int
    without: int | None
    boosted: bool
    classes: int  # 0: values
    depths: tuple[int, ...]  # a forest of the largest depth has the others as its beginnings
    lengths: tuple[int, ...]  # numbers of trees that are judged; the last one is the fit's own
    step: float = 0.1
    least: int = 1
    seed: int = 0
    first: int = 0


def fits_a_task(rows: int, features: int) -> bool:
    return features <= WIDEST and rows * (features + 64) <= LARGEST


# --- bins ------------------------------------------------------------------------------


def thresholds(values: np.ndarray) -> np.ndarray:
    """Spark's rule for one feature: the middles between all values, or those next to equal shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    most = min(BINS, len(values)) - 1
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride, target, upto, picks = len(values) / (most + 1), len(values) / (most + 1), float(counts[0]), []
    for i in range(1, len(found)):
        before, upto = upto, upto + counts[i]
        if abs(before - target) < abs(upto - target):
            picks.append(middles[i - 1])
            target += stride
    return np.array(picks)


def _sights(part: DataFrame, rows: int, folds: Sequence[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Per left-out fold the thresholds of all features, from the rows that are not left out."""
    share = 1.5 * SAMPLED_ROWS / max(rows, 1)  # two of three folds are left
    some = part if share >= 1 else part.sample(share, seed=42)
    fold = F.col("fold").cast("int") if "fold" in part.columns else F.lit(-1)
    told = some.select(vector_to_array("features").alias("x"), fold.alias("fold")).toArrow().combine_chunks()
    if not told.num_rows:
        return {}
    x = np.asarray(told.column(0).combine_chunks().flatten()).reshape(told.num_rows, -1)
    at = np.asarray(told.column(1))
    out = {}
    for without in folds:
        seen = x if without is None else x[at != without]
        out[without] = [thresholds(seen[:, j]) for j in range(x.shape[1])] if len(seen) else None
    return out


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], "left")  # a value at a threshold goes left
    return out


def _keys(x: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """A number per row, the same for rows in the same bins and in an order that hangs on them alone."""
    if math.prod(sizes) < 1 << 62:
        key = np.zeros(len(x), dtype=np.int64)
        for j, size in enumerate(sizes):
            key = key * size + x[:, j]
        return key
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1]))).ravel()
    return np.unique(whole, return_inverse=True)[1].ravel()


@dataclass
class Rows:
    """Rows in bins: per row how many it stands for (None: each for one), the sum of their labels and of its squares (None: of one label)."""

    x: np.ndarray
    fold: np.ndarray
    n: np.ndarray | None
    s: np.ndarray
    q: np.ndarray | None = None

    def arrays(self) -> tuple[np.ndarray | None, ...]:
        return self.x, self.fold, self.n, self.s, self.q

    @property
    def label(self) -> np.ndarray:
        return self.s if self.n is None else self.s / self.n

    @property
    def counts(self) -> np.ndarray:
        return np.ones(len(self.s)) if self.n is None else self.n

    @property
    def squares(self) -> np.ndarray:
        return self.s * self.label if self.q is None else self.q

    def at(self, where: np.ndarray) -> Rows:
        return Rows(*[None if a is None else a[where] for a in self.arrays()])

    def merged(self, sizes: Sequence[int], how: str) -> Rows:
        """In an order that does not hang on how rows came, by bins, fold and label; one row for all with the same of these ("labels"), of bins and fold ("sums"), or none merged ("rows")."""
        key = _keys(self.x, sizes)
        order = np.lexsort((self.fold, key) if how == "sums" else (self.label, self.fold, key))
        new = np.ones(len(order), dtype=bool)
        if how != "rows":
            new[1:] = False
            for a in (key, self.fold) + ((self.label,) if how == "labels" else ()):
                a = a[order]
                new[1:] |= a[1:] != a[:-1]
        if new.all():
            return self.at(order)
        starts = np.flatnonzero(new)
        sums = lambda a: np.add.reduceat(a[order], starts)
        first = order[starts]
        return Rows(self.x[first], self.fold[first], sums(self.counts), sums(self.s), sums(self.squares) if how == "sums" else None)


def _merging(wanted: Wanted) -> str:
    return "labels" if wanted.classes else "sums" if wanted.boosted else "rows"


def _packed(part: int, tasks: Sequence[tuple[int, Wanted]], sights: dict) -> Callable:
    """Per block of rows and task the block in the task's bins."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                cut = batch.slice(start, BLOCK_ROWS)
                y = np.asarray(cut.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)  # null: NaN
                x = np.asarray(cut.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(y), -1)
                fold = np.asarray(cut.column(2).to_numpy(zero_copy_only=False), dtype=np.int16)
                made: dict = {}
                for i, w in tasks:
                    cuts, how = sights[w.without], _merging(w)
                    if (w.without, how) not in made:
                        rows = Rows(binned(x, cuts), fold, None, y)
                        if how != "rows":
                            rows = rows.merged([len(c) + 1 for c in cuts], how)
                        made[w.without, how] = pickle.dumps(rows.arrays(), protocol=5)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([made[w.without, how]], pa.binary())], ["task", "rows"])

    return pack


def _joined(blocks: list[bytes]) -> Rows:
    """The rows of all blocks; the list is emptied on the way."""
    some = []
    while blocks:
        some.append(Rows(*pickle.loads(blocks.pop())))
    counted = any(r.n is not None for r in some)
    summed = any(r.q is not None for r in some)
    parts = [[r.x for r in some], [r.fold for r in some], [r.counts for r in some] if counted else None, [r.s for r in some], [r.squares for r in some] if summed else None]
    del some
    arrays = []
    while parts:
        own = parts.pop(0)
        arrays.append(None if own is None else np.concatenate(own))
        del own
    return Rows(*arrays)


# --- growing -----------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in levels: ``left`` is the left child, the right one comes after it, or for a leaf minus one minus the place of its value."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.split, self.left, self.value

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Per row the value of its leaf."""
        at, live = np.zeros(len(x), dtype=np.int32), np.arange(len(x))
        while len(live):
            here = at[live]
            left = self.left[here]
            inner = left > 0
            live, here, left = live[inner], here[inner], left[inner]
            at[live] = left + (x[live, self.feature[here]] > self.split[here])
        return self.value[-1 - self.left[at]]


class _Levels:
    """A tree while it grows: every level's nodes after those above."""

    def __init__(self):
        self.feature, self.split, self.left, self.totals, self.gains, self.starts = [], [], [], [], [], [0]

    def add(self, totals: np.ndarray, splits: np.ndarray, feature: np.ndarray, split: np.ndarray, gain: np.ndarray) -> None:
        below = self.starts[-1] + len(totals)
        left = np.zeros(len(totals), dtype=np.int32)
        left[splits] = below + 2 * np.arange(splits.sum())
        self.feature.append(np.where(splits, feature, 0).astype(np.int16))
        self.split.append(np.where(splits, split, 0).astype(np.uint8))
        self.left.append(left)
        self.totals.append(totals)
        self.gains.append(np.where(splits, gain, 0.0))
        self.starts.append(below)

    def ended(self, features: int, depth: int, value: Callable, same: Callable | None = None) -> tuple[Tree, np.ndarray]:
        """The tree down to ``depth`` and the importances of its features; as in Spark two leaves that predict the ``same`` are one."""
        n = self.starts[min(depth + 1, len(self.starts) - 1)]
        feature, split, left, totals, gains = (np.concatenate(a)[:n] for a in (self.feature, self.split, self.left, self.totals, self.gains))
        if depth + 1 < len(self.starts):
            left[self.starts[depth] :] = 0
        if same is not None:
            told = same(totals)
            for lo, hi in reversed(list(zip(self.starts, self.starts[1:]))):
                here = np.arange(lo, min(hi, n))
                here = here[left[here] > 0]
                a, b = left[here], left[here] + 1
                left[here[(left[a] == 0) & (left[b] == 0) & (told[a] == told[b])]] = 0
        inner = left > 0
        reached = np.zeros(n, dtype=bool)
        reached[0] = True
        for lo, hi in zip(self.starts, self.starts[1:]):
            here = np.arange(lo, min(hi, n))
            here = left[here[reached[here] & inner[here]]]
            reached[here] = reached[here + 1] = True
        inner &= reached
        worth = np.bincount(feature[inner], weights=gains[inner], minlength=features)
        place = np.cumsum(reached) - 1
        leaf = reached & ~inner
        into = np.where(inner, place[left], -np.cumsum(leaf)).astype(np.int32)
        return Tree(feature[reached], split[reached], into[reached], value(totals[leaf])), worth


class Columns:
    """The features of boosted rows as columns of bins; of features with two bins those that are never set together share a column."""

    def __init__(self, x: np.ndarray, sizes: Sequence[int]):
        self.columns: list[np.ndarray] = []
        self.starts = [0]
        wide, shared = [j for j, z in enumerate(sizes) if z > 2], []
        self.ranges, self.singles, counts = [], [], []
        for j in wide:
            self.ranges.append((j, self.starts[-1], sizes[j]))
            self.columns.append(x[:, j].astype(np.int64))
            self.starts.append(self.starts[-1] + sizes[j])
        for j in (j for j, z in enumerate(sizes) if z == 2):
            is_set = x[:, j] > 0
            for at, (taken, features) in enumerate(shared):
                if not (taken & is_set).any():
                    shared[at] = (taken | is_set, [*features, j])
                    break
            else:
                shared.append((is_set, [j]))
        for _, features in shared:
            column = np.zeros(len(x), dtype=np.int64)
            for place, j in enumerate(features, 1):
                column[x[:, j] > 0] = place
                self.singles.append((j, self.starts[-1] + place))
            self.columns.append(column)
            self.starts.append(self.starts[-1] + len(features) + 1)
        self.width = self.starts[-1]
        options = sorted([(j, s) for j, _, z in self.ranges for s in range(z - 1)] + [(j, 0) for j, _ in self.singles])
        self.feature, self.split = (np.array([o[i] for o in options], dtype=np.int64) for i in (0, 1))
        place = {o: i for i, o in enumerate(options)}
        self.ranges = [(place[j, 0], start, z) for j, start, z in self.ranges]
        self.to = np.array([place[j, 0] for j, _ in self.singles], dtype=np.int64)
        self.of = np.array([at for _, at in self.singles], dtype=np.int64)

    def sums(self, where: np.ndarray, node: np.ndarray, nodes: int, n: np.ndarray | None, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node and bin the rows (each counts once where ``n`` is None) and the sums of ``s``."""
        count, total = np.empty((nodes, self.width)), np.empty((nodes, self.width))
        n, s = None if n is None else n[where], s[where]
        for column, lo, hi in zip(self.columns, self.starts, self.starts[1:]):
            key, size = node * (hi - lo) + column[where], nodes * (hi - lo)
            count[:, lo:hi] = np.bincount(key, weights=n, minlength=size).reshape(nodes, hi - lo)
            total[:, lo:hi] = np.bincount(key, weights=s, minlength=size).reshape(nodes, hi - lo)
        return count, total

    def below(self, sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Per node and possible split the sum of what goes left."""
        out = np.empty((len(sums), len(self.feature)))
        for to, start, size in self.ranges:
            np.cumsum(sums[:, start : start + size - 1], axis=1, out=out[:, to : to + size - 1])
        out[:, self.to] = totals[:, None] - sums[:, self.of]
        return out


def _regressed(columns: Columns, x: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """One tree on sums of values by the largest fall of variance; the importances, and per row the value of its leaf."""
    levels, told = _Levels(), np.empty(len(n))
    alike = None if (n == 1).all() else n
    where, node, nodes = np.arange(len(n)), np.zeros(len(n), dtype=np.int64), 1
    tn, ts, above = np.array([n.sum()]), np.array([s.sum()]), None
    for level in range(depth + 1):
        splits, feature, split, gain = np.zeros(nodes, dtype=bool), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes)
        if level < depth and len(columns.feature):
            if above is None:
                hn, hs = columns.sums(where, node, nodes, alike, s)
            else:  # the smaller of two children is summed, the other one is the rest of their parent
                sizes = np.bincount(node, minlength=nodes).reshape(-1, 2)
                small = 2 * np.arange(nodes // 2) + (sizes[:, 1] < sizes[:, 0])
                of = np.full(nodes, -1)
                of[small] = np.arange(len(small))
                place = of[node]
                mine = np.flatnonzero(place >= 0)
                some = columns.sums(where[mine], place[mine], len(small), alike, s)
                both = []
                for whole, part in zip(above, some):
                    out = np.empty((nodes, columns.width))
                    out[small], out[small ^ 1] = part, whole - part
                    both.append(out)
                hn, hs = both
            ln, ls = columns.below(hn, tn), columns.below(hs, ts)
            rn, rs = tn[:, None] - ln, ts[:, None] - ls
            open_ = (ln > 0.5) & (rn > 0.5)
            score = np.where(open_, ls * ls / np.where(open_, ln, 1.0) + rs * rs / np.where(open_, rn, 1.0), -np.inf)
            at = np.arange(nodes), score.argmax(axis=1)
            gain = score[at] - ts * ts / tn
            splits = gain > NOISE * score[at]
            feature, split = columns.feature[at[1]], columns.split[at[1]]
        levels.add(np.stack([tn, ts], axis=1), splits, feature, split, gain)
        if not splits.all():
            ends = ~splits[node]
            told[where[ends]] = (ts / tn)[node[ends]]
        if not splits.any():
            break
        above = hn[splits], hs[splits]
        left = ln[at][splits], ls[at][splits]
        tn, ts = (np.stack([a, whole[splits] - a], axis=1).ravel() for a, whole in zip(left, (tn, ts)))
        if not splits.all():
            stay = splits[node]
            where, node = where[stay], node[stay]
        rank = np.cumsum(splits) - 1
        node, nodes = 2 * rank[node] + (x[where, feature[node]] > split[node]), len(tn)
    tree, worth = levels.ended(x.shape[1], depth, lambda t: t[:, 1] / t[:, 0])
    return tree, worth, told


def boosted(rows: Rows, held: Rows, sizes: Sequence[int], wanted: Wanted) -> tuple[list[Tree], list[float], np.ndarray, dict[int, np.ndarray]]:
    """Trees, their weights, importances, and after each of the lengths the sums on the held rows, by Spark's rounds: the first tree counts whole, others by the step."""
    n, classify = rows.counts, wanted.classes > 0
    columns = Columns(rows.x, sizes)
    s = 2 * rows.s - n if classify else rows.s  # two classes count as -1 and 1
    told, held_told, worth = np.zeros(len(n)), np.zeros(len(held.s)), np.zeros(rows.x.shape[1])
    grown, weights, at = [], [], {}
    label = s / n
    for i in range(wanted.lengths[-1]):
        if i == 0:
            pull = s
        elif classify:
            with np.errstate(over="ignore"):
                pull = 4.0 * s / (1.0 + np.exp(2.0 * label * told))
        else:
            pull = 2.0 * (s - n * told)
        tree, own, fitted = _regressed(columns, rows.x, n, pull, wanted.depths[-1])
        weight = 1.0 if i == 0 else wanted.step
        told += weight * fitted
        held_told += weight * tree.leaves(held.x)
        worth += own
        grown.append(tree)
        weights.append(weight)
        if i + 1 in wanted.lengths:
            at[i + 1] = held_told.copy()
    return grown, weights, worth, at


def _resampled(x: np.ndarray, w: np.ndarray, y: np.ndarray, classes: int, depth: int, least: int, chosen: int, bins: int, rng: np.random.Generator) -> _Levels:
    """A tree of a forest on weighted rows: every node looks at ``chosen`` features of its own."""
    features, levels, flat = x.shape[1], _Levels(), np.ascontiguousarray(x).ravel()
    kinds = classes or 2
    if classes:
        label = y.astype(np.int64)
    where, node, nodes = np.arange(len(w)), np.zeros(len(w), dtype=np.int64), 1
    for level in range(depth + 1):
        if classes:
            totals = np.bincount(node * kinds + label[where], weights=w[where], minlength=nodes * kinds).reshape(nodes, kinds)
            n, pure = totals.sum(axis=1), (totals > 0).sum(axis=1) <= 1
        else:
            wy = w[where] * y[where]
            totals = np.stack([np.bincount(node, weights=a, minlength=nodes) for a in (w[where], wy)], axis=1)
            n = totals[:, 0]
            pure = n < 2 * least
        splits, feature, split, gain = np.zeros(nodes, dtype=bool), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes)
        open_ = np.flatnonzero(~pure & (n >= 2 * least)) if level < depth else np.zeros(0, np.int64)
        at_once = max(1, CELLS // (chosen * bins * kinds))
        for start in range(0, len(open_), at_once):
            some = open_[start : start + at_once]
            place = np.full(nodes, -1)
            place[some] = np.arange(len(some))
            mine = place[node]
            kept = np.flatnonzero(mine >= 0)
            mine, rows = mine[kept], where[kept]
            if chosen < features:
                looked = np.sort(rng.random((len(some), features)).argpartition(chosen - 1, axis=1)[:, :chosen], axis=1)
            else:
                looked = np.tile(np.arange(features), (len(some), 1))
            key = (mine[:, None] * chosen + np.arange(chosen)) * bins + flat.take(rows[:, None] * features + looked[mine])
            cells, shape = len(some) * chosen * bins, (len(some), chosen, bins)
            weigh = np.repeat(w[rows], chosen)
            if classes:
                found = np.bincount((key + label[rows][:, None] * cells).ravel(), weights=weigh, minlength=cells * kinds).reshape(kinds, *shape)
                sums = [(h.cumsum(axis=2)[:, :, :-1], totals[some, k]) for k, h in enumerate(found)]  # per class what goes left, and all
                ln = sum(left for left, _ in sums)
            else:
                ln, ls = (np.bincount(key.ravel(), weights=a, minlength=cells).reshape(shape).cumsum(axis=2)[:, :, :-1] for a in (weigh, np.repeat(wy[kept], chosen)))
                sums = [(ls, totals[some, 1])]
            rn = n[some][:, None, None] - ln
            good = (ln >= least) & (rn >= least)
            score = sum(left * left for left, _ in sums) / np.where(good, ln, 1.0)
            score += sum((whole[:, None, None] - left) ** 2 for left, whole in sums) / np.where(good, rn, 1.0)
            parent = sum(whole * whole for _, whole in sums) / n[some]
            score = np.where(good, score, -np.inf).reshape(len(some), -1)
            best = score.argmax(axis=1)
            most = score[np.arange(len(some)), best]
            gain[some], splits[some] = most - parent, most - parent > NOISE * most
            feature[some], split[some] = looked[np.arange(len(some)), best // (bins - 1)], best % (bins - 1)
        levels.add(totals, splits, feature, split, gain)
        if not splits.any():
            break
        stay = splits[node]
        where, node = where[stay], node[stay]
        rank = np.cumsum(splits) - 1
        node, nodes = 2 * rank[node] + (flat.take(where * features + feature[node]) > split[node]), 2 * int(splits.sum())
    return levels


def resampled_ones(size: int, rng: np.random.Generator) -> np.ndarray:
    """Poisson counts of mean 1 from draws of 32 bits; above 12 lies less than one draw in 2^32."""
    draws = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    out, upto, chance = np.zeros(size, dtype=np.uint8), 0.0, math.exp(-1.0)
    for count in range(12):
        upto += chance
        chance /= count + 1
        out += draws >= np.uint32(min(round(upto * (1 << 32)), (1 << 32) - 1))
    return out.astype(np.float64)


def forest(rows: Rows, held: Rows, sizes: Sequence[int], wanted: Wanted) -> tuple[list[Tree], np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """Trees of the largest depth, their importances, and per depth and length the votes on the held rows."""
    features, classes = rows.x.shape[1], wanted.classes
    chosen = features if wanted.lengths[-1] == 1 and not wanted.first else math.ceil(math.sqrt(features)) if classes else math.ceil(features / 3.0)
    bins = max(2, *sizes)
    label, many = rows.label, rows.n
    key = _keys(rows.x, sizes)
    new = np.concatenate([[True], key[1:] != key[:-1]])  # rows are in the order of their keys
    gathered = not classes and not new.all()  # of rows in the same bins a tree of values needs the sums alone
    heads, cell = (rows.x[new], np.cumsum(new) - 1) if gathered else (rows.x, None)
    del key, new
    if classes:
        value, same = (lambda t: t / t.sum(axis=1, keepdims=True)), (lambda t: t.argmax(axis=1))
    else:
        value, same = (lambda t: t[:, 1] / t[:, 0]), (lambda t: t[:, 1] / t[:, 0])
    votes = {d: np.zeros((len(held.s), classes) if classes else len(held.s)) for d in wanted.depths}
    at, grown, worth = {}, [], np.zeros(features)

    def drawn(lo: int, hi: int, rng: np.random.Generator) -> np.ndarray:
        return resampled_ones(hi - lo, rng) if many is None else rng.poisson(many[lo:hi]).astype(np.float64)

    for i in range(wanted.lengths[-1]):
        rng = np.random.default_rng([wanted.seed, wanted.first + i])
        if gathered:
            w, y = np.zeros(len(heads)), np.zeros(len(heads))
            for lo in range(0, len(label), DRAWN_AT_ONCE):
                hi = min(lo + DRAWN_AT_ONCE, len(label))
                some = drawn(lo, hi, rng)
                w += np.bincount(cell[lo:hi], weights=some, minlength=len(heads))
                y += np.bincount(cell[lo:hi], weights=some * label[lo:hi], minlength=len(heads))
            y = np.divide(y, w, out=y, where=w > 0)
        else:
            w, y = drawn(0, len(label), rng), label
        some = np.flatnonzero(w)
        if len(some):
            x, w, y = heads[some], w[some], y[some]
        else:  # no row was drawn
            x, w, y = rows.x, rows.counts, label
        levels = _resampled(x, w, y, classes, wanted.depths[-1], wanted.least, chosen, bins, rng)
        for d in wanted.depths:
            tree, own = levels.ended(features, d, value, same)
            if len(held.s):
                votes[d] += tree.leaves(held.x)
        if wanted.without is None:
            grown.append(tree)
            worth += own / own.sum() if own.sum() > 0 else 0.0
        if i + 1 in wanted.lengths:
            at.update({(d, i + 1): v.copy() for d, v in votes.items()})
    return grown, worth, at


def _score(told: np.ndarray, held: Rows, classes: int) -> float:
    """The share of right classes, or R2."""
    counts, squares = held.counts, held.squares
    n = counts.sum()
    if not n:
        return float("nan")
    if classes:
        return float(counts[told == held.label].sum() / n)
    off = (squares - 2 * told * held.s + counts * told * told).sum()
    spread = squares.sum() - held.s.sum() ** 2 / n
    return float(1 - off / spread) if spread else float("nan")


def _grown(wanted: Wanted, rows: Rows, sizes: Sequence[int]) -> dict:
    """What a task tells of its fit: its trees, or its scores on the fold that was left out; nothing if a row has no label or there are no rows."""
    classes, how, label = wanted.classes, _merging(wanted), rows.label
    if not (np.isfinite(label).all() and (not classes or ((label >= 0) & (label < classes) & (label == np.floor(label))).all())):
        return {}
    del label
    if wanted.without is None:
        rows.fold = np.zeros(len(rows.s), dtype=np.int16)  # folds do not matter here
    rows = rows.merged(sizes, how)
    out = rows.fold == wanted.without if wanted.without is not None else np.zeros(len(rows.s), dtype=bool)
    held = rows.at(out)
    if out.any():
        rows = rows.at(~out)
    if not len(rows.s):
        return {}
    if wanted.boosted:
        trees, weights, worth, at = boosted(rows, held, sizes, wanted)
        scores = {(wanted.depths[-1], k): _score((v > 0).astype(np.float64) if classes else v, held, classes) for k, v in at.items()}
    else:
        trees, worth, at = forest(rows, held, sizes, wanted)
        weights = []
        scores = {(d, k): _score(v.argmax(axis=1).astype(np.float64) if classes else v / k, held, classes) for (d, k), v in at.items()}
    return {"scores": scores} if wanted.without is not None else {"trees": [t.arrays() for t in trees], "weights": weights, "worth": worth}


# --- all fits at once ------------------------------------------------------------------------


def grow(parts: Sequence[DataFrame], counts: Sequence[int], wanted: Sequence[Wanted]) -> list[dict] | None:
    """What :func:`_grown` tells of each fit, from one job over all; whole models also have their ``cuts``. None if a fit has no rows or a row has no label."""
    spark = parts[0].sparkSession
    context = spark.sparkContext
    tasks: list[tuple[int, Wanted]] = []  # the fit's place and what its task grows
    for i, w in enumerate(wanted):
        if w.boosted or w.without is not None:
            tasks.append((i, w))
        else:
            n = w.lengths[-1]
            tasks += [(i, replace(w, first=first, lengths=(min(TREES_AT_ONCE, n - first),))) for first in range(0, n, TREES_AT_ONCE)]
    cuts, blocks = {}, []
    for p in sorted({w.part for w in wanted}):
        own = [(k, w) for k, (_, w) in enumerate(tasks) if w.part == p]
        found = _sights(parts[p], counts[p], sorted({w.without for _, w in own}, key=lambda f: -1 if f is None else f))
        if not found or any(c is None for c in found.values()):
            return None
        cuts |= {(p, without): c for without, c in found.items()}
        fold = F.col("fold").cast("int") if "fold" in parts[p].columns else F.lit(-1)
        cells = parts[p].select(vector_to_array("features").alias("x"), F.col("label").alias("y"), fold.alias("fold"))
        blocks.append(cells.mapInArrow(_packed(p, own, found), "task int, rows binary").rdd.map(lambda r: (r["task"], bytes(r["rows"]))))
    plans = {k: (w, [len(c) + 1 for c in cuts[w.part, w.without]]) for k, (_, w) in enumerate(tasks)}

    def run(pairs: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        by_task: dict[int, list[bytes]] = {}
        for k, rows in pairs:
            by_task.setdefault(k, []).append(rows)
        for k in sorted(by_task):
            w, sizes = plans[k]
            yield k, pickle.dumps(_grown(w, _joined(by_task.pop(k)), sizes), protocol=5)

    told = {k: pickle.loads(b) for k, b in context.union(blocks).partitionBy(len(tasks), lambda k: k).mapPartitions(run).collect()}
    if any(not told.get(k) for k in range(len(tasks))):
        return None
    out: list[dict] = [{} for _ in wanted]
    for k, (i, w) in enumerate(tasks):
        if "trees" in out[i]:
            out[i]["trees"] += told[k]["trees"]
            out[i]["worth"] = out[i]["worth"] + told[k]["worth"]
        else:
            out[i] = told[k] | {"cuts": cuts[w.part, w.without]}
    for found in out:
        found["trees"] = [Tree(*t) for t in found.get("trees", [])]
    return out


class Grown:
    """A model of grown trees, used as Spark's models are."""

    def __init__(self, trees: list[Tree], weights: list[float], worth: np.ndarray, cuts: list[np.ndarray], classes: int):
        self.trees, self.weights, self.cuts, self.classes = trees, weights, cuts, classes
        self.featureImportances = DenseVector(worth / worth.sum() if worth.sum() > 0 else worth)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Per row its votes by class, its margin, or its value."""
        sizes = [len(c) + 1 for c in self.cuts]
        _, first, place = np.unique(_keys(bins := binned(x, self.cuts), sizes), return_index=True, return_inverse=True)
        some = bins[first]
        if self.weights:
            total = sum(w * t.leaves(some) for w, t in zip(self.weights, self.trees))
        else:
            total = sum(t.leaves(some) for t in self.trees)
            total = total if self.classes else total / len(self.trees)
        return total[place.ravel()]

    def transform(self, df: DataFrame) -> DataFrame:
        own = self

        def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = np.asarray(batch.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(batch), -1)
                v = own.values(x) if len(batch) else np.zeros((0, 1))
                v = v.reshape(len(batch), -1)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))

        told.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        found = df.withColumn("__told", F.arrow_udf(told, "array<double>")(vector_to_array("features")))
        first = F.element_at("__told", 1)
        if not self.classes:
            return found.withColumn("prediction", first).drop("__told")
        if self.weights:
            raw, second = F.array(-first, first), 1.0 / (1.0 + F.exp(-2.0 * first))
            chance, prediction = F.array(1.0 - second, second), (first > 0).cast("double")
        else:
            raw = F.col("__told")
            whole = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
            chance, prediction = F.transform(raw, lambda v: v / whole), (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
        return found.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(chance), "prediction": prediction}).drop("__told")
