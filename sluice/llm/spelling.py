"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

1. Words are counted where they are read; only counts are shuffled. The
   vocabulary holds what is long and frequent enough.
2. Its words go into blocked Bloom filters, one per length. A word's bits lie in
   one block of 512 bits, ``BITS`` per word, so a probe touches one cache line.
   Filters are built by tasks that hold a slice of blocks each, and are broadcast
   in rounds of at most ``ROUND_BYTES``: one round for some tens of millions of
   words, several beyond, each probing the lengths and blocks it holds. So the
   broadcast is bounded and any vocabulary is covered.
3. Every word generates its neighbourhood: all deletions of one code point, and
   all replacements by a larger one of the alphabet. Being near is symmetric, so
   a deletion stands for the insertion the other way round, and a replacement
   for its reverse. Edits are never spelled out: their hashes follow from prefix
   sums of the word's, thousands of words in one go.
4. Edits the filters know are spelled out and shuffled to a join with the
   vocabulary, which removes the false positives.
5. A word's form is its most frequent near word if that is ``RATIO`` times as
   frequent. Forms grow at every step, so their chains are short; pointer jumping
   halves them until nothing moves.

A null text has no words, a null key is the empty string in the rule that damages
words. Ties between forms go to the smallest word in code-point order. Rows that
repeat count again. An empty table gives no rows. A long text is a task's only
text for a while, its words are counted like any others. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import texts as X

# fixed values: what a word is
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0xFF + 1)]
DAMAGE = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5

BITS, PROBES, BLOCK_BITS = 24, 6, 512
WORDS_PER_BLOCK = BLOCK_BITS // BITS
ROUND_BYTES = 64 << 20
SLICE_BLOCKS = 1 << 14  # blocks that one task builds: 1 MB
STEP_EDITS = 1 << 20

_CODES = np.random.default_rng(5 * 6).integers(1, 1 << 63, 256, dtype=np.uint64)  # one per code point below 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(df: DataFrame, key: str = "doc_id", text: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``word`` and ``n`` of all runs of letters, after the rule that takes a letter out of some of them.

    A run loses the code point at ``h % length`` if ``damage`` divides ``h``, the crc32 of ``<key>:<run>``.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"),
        F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUNS), F.lit(0))).alias("__run"),
    ).select("__key", F.translate("__run", upper, upper.lower()).alias("__run"))
    h = F.crc32(F.concat_ws(":", "__key", "__run").cast("binary"))
    hashed = runs.select("__run", h.alias("__h"))
    at = (F.col("__h") % F.length("__run")).cast("int")
    cut = F.concat(F.substring("__run", F.lit(1), at), F.substring("__run", at + 2, F.length("__run")))
    return hashed.select(F.when(F.col("__h") % damage == 0, cut).otherwise(F.col("__run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    return counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


class Spelled:
    """Words of one length as a matrix of code points, with hashes that edits can be derived from."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.length = matrix, matrix.shape[1]
        self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.length, _BASE)]))
        self.terms = _CODES[matrix] * self.powers[: self.length]
        self.total = self.terms.sum(axis=1, dtype=np.uint64)

    @classmethod
    def by_length(cls, column: pa.Array) -> Iterator[tuple[np.ndarray, Spelled]]:
        """Row numbers and words of every length. All letters lie below 256, so a word is its bytes in Latin-1."""
        words = column.to_pylist()
        lengths = np.array([len(w) for w in words], np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            body = "".join(words[i] for i in rows).encode("latin-1")
            yield rows, cls(np.frombuffer(body, np.uint8).reshape(len(rows), int(length)))

    def hashes(self) -> np.ndarray:
        return X.mixed(self.total)

    def deletions(self) -> np.ndarray:
        """Hashes of the words without the code point at each place (words x places)."""
        before = np.cumsum(self.terms, axis=1, dtype=np.uint64) - self.terms
        after = self.total[:, None] - before - self.terms
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        return X.mixed(before + after * inverse)

    def replacements(self, letter: int) -> np.ndarray:
        """Hashes of the words with ``letter`` at each place."""
        return X.mixed(self.total[:, None] - self.terms + _CODES[letter] * self.powers[: self.length])


def _marks(hashes: np.ndarray) -> list[np.ndarray]:
    """The bit numbers of a hash within its block."""
    again = X.mixed(hashes + np.uint64(0xA0761D6478BD642F))
    return [((again >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for i in range(PROBES)]


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a hash: its upper 32 bits, scaled."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """The blocks ``[start, start + held)`` of the Bloom filter of one length, which has ``blocks`` in all."""

    length: int
    blocks: int
    start: int
    bits: np.ndarray  # held x 8 longs

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        """Whether a word may be in the vocabulary; False where its block lies elsewhere."""
        at = _block(hashes, self.blocks) - self.start
        inside = (at >= 0) & (at < len(self.bits))
        found = np.zeros(hashes.shape, bool)
        at, marks = at[inside], _marks(hashes[inside])
        hit = np.ones(len(at), bool)
        for m in marks:
            hit &= (self.bits[at, m >> 6] >> (m & 63).astype(np.uint64)) & np.uint64(1) == 1
        found[inside] = hit
        return found


def _slices(vocab: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """The Bloom filters of the lengths in ``sizes`` (length: blocks), in slices of blocks: ``length``, ``slice``, ``bits``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, spelled in Spelled.by_length(batch.column("word")):
                if blocks := sizes.get(spelled.length):
                    h = spelled.hashes()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), spelled.length, np.int32)), pa.array((_block(h, blocks) // SLICE_BLOCKS).astype(np.int32)), pa.array(h.view(np.int64))], names=["length", "slice", "h"])

    def build(table: pa.Table) -> pa.Table:
        length, slice_ = table.column("length")[0].as_py(), table.column("slice")[0].as_py()
        h, blocks = table.column("h").to_numpy().view(np.uint64), sizes[length]
        held = min(SLICE_BLOCKS, blocks - slice_ * SLICE_BLOCKS)
        bits, at = np.zeros(held * 8, np.uint64), _block(h, blocks) - slice_ * SLICE_BLOCKS
        for m in _marks(h):
            np.bitwise_or.at(bits, at * 8 + (m >> 6), np.uint64(1) << (m & 63).astype(np.uint64))
        return pa.table([pa.array([length], pa.int32()), pa.array([slice_], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["length", "slice", "bits"])

    return vocab.mapInArrow(place, X.schema("length int, slice int, h bigint")).groupBy("length", "slice").applyInArrow(build, X.schema("length int, slice int, bits binary"))


def rounds(sizes: dict[int, int], most: int = ROUND_BYTES) -> list[list[tuple[int, int]]]:
    """All slices (length, number) in rounds of at most ``most`` bytes, one slice at least."""
    out: list[list[tuple[int, int]]] = []
    held = most
    for length, blocks in sorted(sizes.items()):
        for number in range(-(-blocks // SLICE_BLOCKS)):
            size = min(SLICE_BLOCKS, blocks - number * SLICE_BLOCKS) * BLOCK_BITS // 8
            if held + size > most:
                out, held = [*out, []], 0
            out[-1].append((length, number))
            held += size
    return out


def _positives(vocab: DataFrame, sent: Broadcast[list[Filter]]) -> DataFrame:
    """``word``, ``n`` and ``edit`` of all generated edits that the filters know."""

    def edits(spelled: Spelled, rows: np.ndarray, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        for f in (f for f in sent.value if f.length == spelled.length - 1):
            known = f.knows(spelled.deletions())
            same = np.zeros_like(known)  # within a run of equal letters all deletions are one
            same[:, 1:] = spelled.matrix[:, 1:] == spelled.matrix[:, :-1]
            i, at = np.nonzero(known & ~same)
            yield rows[i], [words[rows[a]][:b] + words[rows[a]][b + 1 :] for a, b in zip(i, at)]
        own = [f for f in sent.value if f.length == spelled.length]
        for letter in LETTERS if own else ():
            h, larger = spelled.replacements(letter), spelled.matrix < letter
            for f in own:
                known = np.zeros(h.shape, bool)
                known[larger] = f.knows(h[larger])
                i, at = np.nonzero(known)
                yield rows[i], [words[rows[a]][:b] + chr(letter) + words[rows[a]][b + 1 :] for a, b in zip(i, at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for rows, spelled in Spelled.by_length(batch.column("word")):
                step = max(1, STEP_EDITS // spelled.length)
                for low in range(0, len(rows), step):
                    part = Spelled(spelled.matrix[low : low + step])
                    for at, found in edits(part, rows[low : low + step], words):
                        if len(at):
                            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(found, pa.string())], names=["word", "n", "edit"])

    return vocab.mapInArrow(run, X.schema("word string, n bigint, edit string"))


def near_pairs(spark: SparkSession, vocab: DataFrame, most: int = ROUND_BYTES) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every pair of the (written) vocabulary one edit apart, once."""
    per_length = vocab.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()  # a row per length of a word
    sizes = {r["length"]: -(-r["words"] // WORDS_PER_BLOCK) for r in per_length}
    slices = X.written(_slices(vocab, sizes))
    exact = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = vocab.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    for wanted in rounds(sizes, most):
        chosen = F.array(*[F.struct(F.lit(a).alias("length"), F.lit(b).alias("slice")) for a, b in wanted])
        rows = slices.where(F.array_contains(chosen, F.struct("length", "slice"))).collect()  # at most ``most`` bytes
        filters = [Filter(r["length"], sizes[r["length"]], r["slice"] * SLICE_BLOCKS, np.frombuffer(bytes(r["bits"]), np.uint64).reshape(-1, 8)) for r in rows]
        sent = spark.sparkContext.broadcast(filters)
        true = _positives(vocab, sent).join(exact, F.col("edit") == F.col("near")).select("word", "n", "near", "near_n")
        found = found.unionByName(X.written(true))  # each round ends before the next is sent
        sent.unpersist()
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words with a form: forms are followed until nothing moves."""
    links = X.written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        stepped = X.written(links.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        links = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return links


def variants(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: int = DAMAGE, most: int = ROUND_BYTES
) -> DataFrame:
    """One row per word of the vocabulary: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``."""
    vocab = X.written(vocabulary(words(df, key, text, damage), least_length, least_count))
    pairs = near_pairs(df.sparkSession, vocab, most)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # most frequent, then smallest
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = -F.col("best")["less"]
    takes = chosen >= ratio * F.col("n")
    formed = X.written(near.select("word", "n_near", F.when(takes, F.col("best")["near"]).alias("form"), F.when(takes, chosen).alias("form_n")))
    roots = _roots(formed.where(F.col("form").isNotNull()))
    return (
        vocab.join(formed, "word", "left")
        .join(roots, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )
