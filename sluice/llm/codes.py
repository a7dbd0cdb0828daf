"""Vectors as short codes: integer product quantisation whose assignments are pruned by Drake's adaptive bounds.

A vector's components become integers, its parts are coded by the number of the
nearest entry of their codebook (squared Euclidean distance, ties to the lower
number). Codebooks start from the vectors with the smallest keys and are refined
in rounds of assignment and componentwise mean, both in integers.

Every round reads the state of the last one and writes its own, one row per
vector: the assigned entries and, per part, an upper bound of the distance to the
assigned entry, its ``b`` closest other entries with ordered lower bounds, and one
outer bound below the distances of all entries not listed. When entries move,
bounds move by as much. A part whose upper bound lies below its first lower bound
keeps its entry unseen. Otherwise only the entries whose bounds do not rule them
out are measured, in exact integers; all entries only if the outer bound does not
hold either. ``b`` follows what the last round needed: the depth that was enough
for ``ENOUGH`` of all parts. Bounds are floating point and move by ``EASE`` more
than computed, so that rounding cannot make them wrong; equal distances are never
ruled out.

The driver holds the codebooks (entries x dimension) and their sums; a round sends
it one row per part and entry. Only parts that changed their entry are added up.

Vectors that are null, empty, or hold null or non-finite components take no part,
nor do those whose length differs from that of the smallest kept key (ties: the
smaller vector). A null key comes after all others. Rows that repeat a key are
coded each. With fewer vectors than entries there are as many entries as vectors;
an empty table gives no rows. Parts differ by at most one component. Components
beyond ``LARGEST`` after scaling raise an error, since exact sums could not hold
them. Other columns, whatever their names, are not read; a null label counts as a
label of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import texts as X

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
LARGEST = 1 << 24  # of a scaled component; squares of 2**13 differences of twice that stay below 2**63
WIDEST, NARROWEST = 8, 1  # closest entries kept per part
ENOUGH = 0.97  # share of parts that the kept entries should settle
EASE = 1e-9  # share by which bounds are loosened
SALTS = 64  # rows of one label are dealt to so many tasks
STEP_ROWS = 8192
UNKNOWN = 255  # in place of an entry's number: the outer bound, from here on all are measured

STATE_COLUMNS = "key bigint", "label bigint", *(f"{c} binary" for c in ("own", "code", "was", "upper", "near", "low", "depth"))
STATE = ", ".join(STATE_COLUMNS)
Books = list[np.ndarray]  # per part: entries x components


@dataclass(frozen=True)
class Coded:
    """``rows``: ``key``, ``label``, ``code`` (one byte per part), ``error``; ``books`` as lists of integers by part, entry, position."""

    rows: DataFrame
    books: list[list[list[int]]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.books for entry in part for x in entry).encode()).hexdigest()


def _integers(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``key``, ``label`` and ``vec`` (array of longs) of the vectors that take part, all of one length."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col(vector).isNotNull() & (F.size(F.col(vector)) > 0)).where(finite)
    rows = kept.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.transform(parts, lambda x: F.floor(x * scale).cast("long")).alias("vec"))
    return rows.where(F.when(F.exists("vec", lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit(f"components beyond {LARGEST} after scaling cannot be summed exactly"))).otherwise(F.lit(True)))


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector start, and its end."""
    return [dim * p // parts for p in range(parts + 1)]


def _measured(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all entries."""
    return np.stack([((vectors - entry) ** 2).sum(axis=1) for entry in book], axis=1)


class Bounds:
    """The bounds of one part of many vectors: ``upper``, ``near`` and ``low`` (closest entries and their bounds, then the outer one)."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray):
        self.code, self.upper, self.near, self.low = code, upper, near, low

    @classmethod
    def fresh(cls, vectors: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        """Everything measured; ``b`` others are kept."""
        squared = _measured(vectors, book)
        code = squared.argmin(axis=1)  # the lower number of equal ones
        others = squared.astype(np.float64)
        others[np.arange(len(code)), code] = -1
        order = np.argsort(others, axis=1, kind="stable")[:, 1 : b + 2]
        far = np.sqrt(np.take_along_axis(others, order, axis=1)) * (1 - EASE)
        near = np.full((len(code), b + 1), UNKNOWN, np.int64)
        low = np.full((len(code), b + 1), np.inf)
        near[:, : order.shape[1]], low[:, : order.shape[1]] = order, far
        near[:, b] = UNKNOWN
        upper = np.sqrt(squared[np.arange(len(code)), code].astype(np.float64)) * (1 + EASE)
        return cls(code, upper, near, low)

    def widened(self, b: int) -> Bounds:
        """Kept entries cut to ``b``, or filled up with the outer bound."""
        have = self.near.shape[1] - 1
        if b <= have:
            low = np.concatenate([self.low[:, :b], self.low[:, b:].min(axis=1, keepdims=True)], axis=1)
            return Bounds(self.code, self.upper, np.concatenate([self.near[:, :b], np.full((len(low), 1), UNKNOWN)], axis=1), low)
        more = b - have
        return Bounds(self.code, self.upper, np.pad(self.near, ((0, 0), (0, more)), constant_values=UNKNOWN), np.pad(self.low, ((0, 0), (0, more)), mode="edge"))

    def moved(self, moves: np.ndarray) -> None:
        """Entries have moved by ``moves``; the outer bound falls by the farthest of them."""
        self.upper = (self.upper + moves[self.code]) * (1 + EASE)
        fall = np.where(self.near == UNKNOWN, moves.max(), moves[np.minimum(self.near, len(moves) - 1)])
        self.low = (self.low - fall) * (1 - EASE) - EASE
        self.low = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]  # ordered: what follows is no closer

    def settle(self, vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Assign every part anew; tells how many kept entries each had to look at."""
        n, b = len(self.code), self.near.shape[1] - 1
        depth = np.zeros(n, np.int64)
        open_rows = np.flatnonzero(self.upper >= self.low[:, 0])
        if not len(open_rows):
            return depth
        exact = ((vectors[open_rows] - book[self.code[open_rows]]) ** 2).sum(axis=1)
        self.upper[open_rows] = np.sqrt(exact.astype(np.float64)) * (1 + EASE)
        reach = (self.low[open_rows] <= self.upper[open_rows, None]).sum(axis=1)  # bounds are ordered: the first so many are uncertain
        depth[open_rows] = reach
        known = (self.near[open_rows] != UNKNOWN).sum(axis=1)
        for j in np.unique(reach):
            at = np.flatnonzero((reach == j) & (reach <= known))
            if j and len(at):
                self._partly(vectors, book, open_rows[at], exact[at], int(j))
        at = open_rows[reach > known]
        if len(at):
            whole = Bounds.fresh(vectors[at], book, b)
            self.code[at], self.upper[at], self.near[at], self.low[at] = whole.code, whole.upper, whole.near, whole.low
        return depth

    def _partly(self, vectors: np.ndarray, book: np.ndarray, at: np.ndarray, exact: np.ndarray, j: int) -> None:
        """Measure the ``j`` closest entries of the rows ``at``; all others are farther than the assigned one."""
        entries = np.concatenate([self.code[at][:, None], self.near[at, :j]], axis=1)
        squared = np.concatenate([exact[:, None], np.stack([((vectors[at] - book[entries[:, i + 1]]) ** 2).sum(axis=1) for i in range(j)], axis=1)], axis=1)
        order = np.lexsort((entries, squared), axis=1)
        entries, squared = np.take_along_axis(entries, order, axis=1), np.take_along_axis(squared, order, axis=1)
        far = np.sqrt(squared.astype(np.float64))
        self.code[at], self.upper[at] = entries[:, 0], far[:, 0] * (1 + EASE)
        self.near[at[:, None], np.arange(j)] = entries[:, 1:]
        self.low[at[:, None], np.arange(j)] = far[:, 1:] * (1 - EASE)
        self.low[at] = np.minimum.accumulate(self.low[at][:, ::-1], axis=1)[:, ::-1]


def _column(values: np.ndarray, kind: str) -> pa.Array:
    """One binary value per row."""
    rows = np.ascontiguousarray(values.reshape(len(values), -1).astype(kind))
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _read(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _started(rows: DataFrame, books: Books, edges: list[int], b: int) -> DataFrame:
    """The state after the first assignment, all entries measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(low, STEP_ROWS)
                own = np.array(batch.column("vec").to_pylist(), np.int64).reshape(batch.num_rows, -1)
                found = [Bounds.fresh(own[:, edges[p] : edges[p + 1]], book, b) for p, book in enumerate(books)]
                yield _row(batch, own, found, np.full((len(own), len(books)), UNKNOWN), np.full((len(own), len(books)), b))

    return rows.mapInArrow(run, X.schema(STATE))


def _row(batch: pa.RecordBatch, own: np.ndarray, found: list[Bounds], was: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
    stack = lambda name, kind: _column(np.stack([getattr(f, name) for f in found], axis=1), kind)
    columns = [batch.column("key"), batch.column("label"), _column(own, "<i4"), stack("code", "u1"), _column(was, "u1")]
    columns += [stack("upper", "<f8"), stack("near", "u1"), stack("low", "<f8"), _column(depth, "u1")]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATE_COLUMNS])


def _next(state: DataFrame, books: Books, moves: list[np.ndarray], edges: list[int], b: int) -> DataFrame:
    """The state after one more assignment, with the entries that bounds do not rule out measured."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                n = batch.num_rows
                own = _read(batch.column("own"), "<i4", n).astype(np.int64)
                code, upper = _read(batch.column("code"), "u1", n).astype(np.int64), _read(batch.column("upper"), "<f8", n)
                near, low = (_read(batch.column(c), kind, n).reshape(n, parts, -1) for c, kind in (("near", "u1"), ("low", "<f8")))
                found, depth = [], []
                for p, book in enumerate(books):
                    bounds = Bounds(code[:, p].copy(), upper[:, p], near[:, p].astype(np.int64), low[:, p]).widened(b)
                    bounds.moved(moves[p])
                    depth.append(bounds.settle(own[:, edges[p] : edges[p + 1]], book))
                    found.append(bounds)
                yield _row(batch, own, found, code, np.stack(depth, axis=1))

    return state.mapInArrow(run, X.schema(STATE))


def _changes(state: DataFrame, edges: list[int], k: int) -> DataFrame:
    """Per part and entry what the parts that changed their entry add and take away, one row per task, and the depths needed (part -1)."""
    parts, width = len(edges) - 1, max(b - a for a, b in zip(edges, edges[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, depths = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), np.zeros(WIDEST + 2, np.int64)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            own = _read(batch.column("own"), "<i4", n).astype(np.int64)
            code, was = (_read(batch.column(c), "u1", n).astype(np.int64) for c in ("code", "was"))
            depths += np.bincount(_read(batch.column("depth"), "u1", n).ravel(), minlength=len(depths))[: len(depths)]
            for p in range(parts):
                piece, changed = own[:, edges[p] : edges[p + 1]], code[:, p] != was[:, p]
                for entry in range(k):
                    for sign, column in ((1, code), (-1, was)):
                        hit = changed & (column[:, p] == entry)
                        sums[p, entry, : piece.shape[1]] += sign * piece[hit].sum(axis=0)
                        counts[p, entry] += sign * int(hit.sum())
        at = [(p, e) for p in range(parts) for e in range(k) if counts[p, e] or sums[p, e].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(p for p, _ in at), -1], pa.int32()), pa.array([*(e for _, e in at), 0], pa.int32()), pa.array([*(int(counts[x]) for x in at), 0], pa.int64()), pa.array([*(sums[x].tolist() for x in at), depths.tolist()], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return state.mapInArrow(run, X.schema("part int, entry int, n bigint, sums array<bigint>"))


def _totals(state: DataFrame, edges: list[int], k: int) -> tuple[list[tuple], list[int]]:
    """The changes of all tasks summed: a row per part and entry; and how many parts needed each depth."""
    width = max(WIDEST + 2, *(b - a for a, b in zip(edges, edges[1:])))
    total = lambda i: F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}")
    rows = _changes(state, edges, k).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[total(i) for i in range(width)]).collect()
    plain = [(r["part"], r["entry"], int(r["n"]), [int(r[f"s{i}"] or 0) for i in range(width)]) for r in rows]
    return [r for r in plain if r[0] >= 0], next((r[3][: WIDEST + 2] for r in plain if r[0] < 0), [0] * (WIDEST + 2))


def needed(depths: list[int]) -> int:
    """The number of kept entries that would have settled ``ENOUGH`` of all parts."""
    reached = np.cumsum(depths)
    return int(np.clip(np.searchsorted(reached, ENOUGH * reached[-1]), NARROWEST, WIDEST)) if reached[-1] else WIDEST


def encode(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Coded:
    """Codes and errors of all vectors, and the codebooks after ``rounds`` rounds."""
    if entries > UNKNOWN:
        raise ValueError(f"at most {UNKNOWN} entries")
    every = _integers(df, key, vector, label, scale)
    smallest = every.orderBy(F.col("key").asc_nulls_last(), "vec").limit(1).collect()
    schema = X.schema("key bigint, label bigint, code binary, error bigint")
    if not smallest:
        return Coded(df.sparkSession.createDataFrame([], schema), [])
    dim = len(smallest[0]["vec"])
    kept = every.where(F.size("vec") == dim)
    first = kept.orderBy(F.col("key").asc_nulls_last(), "vec").limit(entries).collect()
    edges, k = cuts(dim, parts), len(first)
    start = np.array([r["vec"] for r in first], np.int64)
    books = [start[:, edges[p] : edges[p + 1]] for p in range(parts)]
    sums, counts = [[[0] * book.shape[1] for _ in range(k)] for book in books], [[0] * k for _ in books]
    b = min(WIDEST, max(k // 2, NARROWEST))
    state = X.written(_started(kept, books, edges, b))
    for _ in range(rounds):
        changed, depths = _totals(state, edges, k)
        for part, entry, n, values in changed:
            counts[part][entry] += n
            sums[part][entry] = [x + y for x, y in zip(sums[part][entry], values)]
        fresh = [np.array([[x // n for x in s] if n else old.tolist() for s, n, old in zip(sums[p], counts[p], book)], np.int64).reshape(book.shape) for p, book in enumerate(books)]
        moves = [np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + EASE) for new, old in zip(fresh, books)]
        books, b = fresh, needed(depths)
        last, state = state, X.written(_next(state, books, moves, edges, b))
        X.forget(last)
    return Coded(_errors(state, books, edges), [book.tolist() for book in books])


def _errors(state: DataFrame, books: Books, edges: list[int]) -> DataFrame:
    """The final codes with their exact squared distances, summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                own, code = _read(batch.column("own"), "<i4", n).astype(np.int64), _read(batch.column("code"), "u1", n)
                error = sum(((own[:, edges[p] : edges[p + 1]] - book[code[:, p]]) ** 2).sum(axis=1) for p, book in enumerate(books))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), batch.column("code"), pa.array(error, pa.int64())], names=["key", "label", "code", "error"])

    return state.mapInArrow(run, X.schema("key bigint, label bigint, code binary, error bigint"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error of all rows of the same label. Rows of one label are dealt over salts on their way to its sum."""
    salt = F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    spread = totals.select(F.col("label").alias("__label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = coded.withColumn("__at", salt)
    return salted.join(spread, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__at") == F.col("__salt")), "left").select(*coded.columns, "label_error")
