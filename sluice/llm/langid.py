"""Language identification by prediction by partial matching.

Every language gets a byte context tree of orders 0 to 3. The cost of a byte
after a context is -log2 c/(n+d) where the context has seen it (c of n times, d
different bytes); else the context's escape cost, -log2 d/(n+d), and the cost
after the context without its oldest byte; in the end one of 256. The statistics
are frozen after the fit, so the cost of a byte depends on four bytes only: all
costs are tabled for all languages at once, and a text's code length is a sum of
looked-up rows. The language that codes a text shortest is predicted; the score
is its share when code lengths count as probabilities.

The fit takes whole texts of at most ``FIT_ROWS`` labelled rows per language,
those with the smallest draws by key; predictions cover whole texts of all rows.

Null texts, empty ones and those without letters get ``und`` and score 0. Rows
without a language are not learnt from; if there are none to learn from, all are
``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.draws import wide_draw
from sluice.llm import texts as X

FIT_ROWS = 512
ORDER = 3
PAD = 10  # texts start as if after three line breaks
UNKNOWN = "und"


def _grams(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the four bytes up to it as one number, and the first of each text."""
    n = len(at) - 1
    padded = np.full(len(body) + ORDER * n, PAD, np.uint32)
    padded[np.arange(len(body)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(at))] = body
    key = np.zeros(len(padded), np.uint32)
    for back in range(ORDER + 1):
        key[back:] |= padded[: len(padded) - back] << np.uint32(8 * back)
    inside = np.ones(len(padded), bool)
    for k in range(ORDER):
        inside[at[:-1] + ORDER * np.arange(n) + k] = False
    return key[inside], at


def counts(labelled: DataFrame) -> DataFrame:
    """How often each four bytes end at a byte, by language: ``lang``, ``gram``, ``n``. ``labelled`` has ``key``, ``text``, ``lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            names = batch.column("lang").to_pylist()
            grams, first = _grams(body, at)
            for lang in sorted(set(names)):
                own = np.concatenate([grams[first[i] : first[i + 1]] for i, x in enumerate(names) if x == lang])
                value, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    found = labelled.mapInArrow(count, X.schema("lang string, gram bigint, n bigint"))
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Rows:
    """Rows of costs found by number through an open hash table."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows = rows
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift = np.uint32(32 - bits)
        self.mask = np.uint32((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint32)
        self.spot = np.full(1 << bits, -1, np.int32)
        left, number, self.probes = keys.astype(np.uint32), np.arange(len(keys), dtype=np.int32), 0
        place = self._place(left)
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.spot[place] < 0)
            self.spot[place[free]] = number[free]  # of several for one place the last stays
            self.keys[place[free]] = left[free]
            put = self.spot[place] == number
            left, number, place = left[~put], number[~put], (place[~put] + np.uint32(1)) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        place = self._place(keys)
        found = self.spot[place]
        found[self.keys[place] != keys] = -1
        for probe in range(1, self.probes):
            miss = np.flatnonzero(found < 0)
            if not len(miss):
                break
            at = (place[miss] + np.uint32(probe)) & self.mask
            found[miss] = np.where(self.keys[at] == keys[miss], self.spot[at], -1)
        return found


class Costs:
    """The cost in bits of a byte after its context, for all languages."""

    def __init__(self, langs: list[str], grams: np.ndarray, numbers: np.ndarray, table: np.ndarray):
        """``grams`` with the language ``numbers`` and counts ``table`` of each."""
        self.langs = langs
        width = len(langs)
        self.seen: list[Rows] = []  # by order: costs of what some language has seen
        self.escape: list[Rows] = []  # by order: escape costs of contexts
        for order in range(ORDER + 1):
            low = grams & ((1 << 8 * (order + 1)) - 1)
            keys, spot = np.unique(low, return_inverse=True)
            c = np.zeros((len(keys), width))
            np.add.at(c, (spot, numbers), table)
            context, group = np.unique(keys >> 8, return_inverse=True)
            n, d = np.zeros((len(context), width)), np.zeros((len(context), width))
            np.add.at(n, group, c)
            np.add.at(d, group, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, np.log2((n + d) / np.maximum(d, 1)), 0.0)
                own = np.log2((n + d)[group] / c)
            below = self._lower(order, keys) + escape[group]
            self.seen.append(Rows(keys, np.where(c > 0, own, below).astype(np.float32)))
            self.escape.append(Rows(context, escape.astype(np.float32)))

    def _lower(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        return self.cost(order - 1, (keys & ((1 << 8 * order) - 1)).astype(np.uint32))

    def cost(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Costs under contexts of at most ``order`` bytes; ``keys`` hold the context and the byte."""
        spot = self.seen[order].find(keys)
        out = self.seen[order].rows[spot]
        miss = np.flatnonzero(spot < 0)
        if len(miss):
            below = self._lower(order, keys[miss])
            context = self.escape[order].find(keys[miss] >> np.uint32(8))
            known = context >= 0
            below[known] += self.escape[order].rows[context[known]]
            out[miss] = below
        return out

    def lengths(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code length of every text in every language, in bits."""
        keys, first = _grams(body, at)
        upto = np.zeros((len(keys) + 1, len(self.langs)))
        np.cumsum(self.cost(ORDER, keys), axis=0, out=upto[1:], dtype=np.float64)
        return upto[first[1:]] - upto[first[:-1]]


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Costs | None:
    """Context trees of all languages from at most ``fit_rows`` rows of each that may be learnt from."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    usable = rows.where(F.col("lang").isNotNull() & ~X.held_out(F.col("key")) & F.col("key").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key"))
    chosen = usable.select("key", "lang", wide_draw("key", "language").alias("draw")).withColumn("rank", rank).where(F.col("rank") <= fit_rows)
    taken = F.broadcast(chosen.select("key", "lang").distinct())  # fit_rows keys a language
    found = counts(usable.where(F.col("text").isNotNull()).join(taken, ["key", "lang"], "left_semi")).toArrow()
    if not found.num_rows:
        return None
    langs = sorted(set(found.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    numbers = np.array([number[x] for x in found.column("lang").to_pylist()])
    return Costs(langs, found.column("gram").to_numpy(), numbers, found.column("n").to_numpy().astype(float))


def _lettered(batch: pa.RecordBatch, body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    upto = np.concatenate(([0], np.cumsum(ascii_letter[body])))
    some = upto[at[1:]] > upto[at[:-1]]
    for i in np.flatnonzero(~some & (np.diff(at) > 0)):
        text = body[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")
        some[i] = any(c.isalpha() for c in text)
    return some


def predict(df: DataFrame, costs: Costs | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and the bits a byte for every row."""

    def run(batches: Iterator[pa.RecordBatch], shared=None) -> Iterator[pa.RecordBatch]:
        model = shared.value if shared is not None else None
        for batch, body, at in X.steps(batches, limit=X.STEP_BYTES // 4):
            n = len(at) - 1
            names, score, rate = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            some = np.flatnonzero(_lettered(batch, body, at)) if model is not None else np.zeros(0, int)
            if len(some):
                bits = model.lengths(body, at)[some]
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(some)), best]
                score[some] = 1.0 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
                rate[some] = least / np.maximum(np.diff(at)[some], 1)
                names[some] = np.array(model.langs, object)[best]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rate)], names=["key", "lang_pred", "score", "bits_per_byte"])

    shared = df.sparkSession.sparkContext.broadcast(costs) if costs is not None else None
    return X.prepared(df, key, text).mapInArrow(lambda batches: run(batches, shared), X.schema("key bigint, lang_pred string, score double, bits_per_byte double"))
