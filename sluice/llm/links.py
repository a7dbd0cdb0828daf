"""Links between texts with similar shingle sets: exact sketches that rule pairs out, confirmation on full sets, components.

Sets are distinct word shingles, as 64-bit hashes. Two sets are linked if their
Jaccard similarity reaches ``percent`` in a hundred; all bounds are in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import texts as X

SKETCH_BITS = 2048
BROADCAST_ROWS = 1 << 20  # of a key and a digest
SALT_PAIRS = 512  # pairs of one class that stay together


def sketch(members: np.ndarray) -> bytes:
    """The parities of how many members fall on each of ``SKETCH_BITS`` places.

    Two sketches differ in no more places than their sets have members that the other lacks.
    """
    places = (X.mixed(members * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(53)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def sketches(column: pa.Array) -> np.ndarray:
    """A column of sketches as one row of longs each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` with these sketches may be linked; never False for linked ones."""
    return (100 + percent) * np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= (100 - percent) * (n + m)


def most_alike(i: np.ndarray, j: np.ndarray, unlike: np.ndarray, component: np.ndarray, rep: np.ndarray, tries: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs ``i``, ``j`` (row numbers) the ``tries`` most alike ones of each ``i`` and component of ``j``; all without ``tries``.

    The third array tells whose ``i`` had more of that component.
    """
    order = np.lexsort((rep[j], unlike, component[j], i))
    i, j = i[order], j[order]
    start = np.ones(len(i), bool)
    start[1:] = (i[1:] != i[:-1]) | (component[j][1:] != component[j][:-1])
    group = np.cumsum(start) - 1
    rank = np.arange(len(i)) - np.flatnonzero(start)[group] if len(i) else np.zeros(0, np.int64)
    keep = rank < tries if tries else np.ones(len(i), bool)
    cut = np.isin(group, group[~keep])
    return i[keep], j[keep], cut[keep]


def digest(members: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def few(df: DataFrame, keys: int = 1) -> bool:
    """Whether a table of ``keys`` keys a row (and digests) is small enough to be sent to all tasks."""
    return df.limit(BROADCAST_ROWS // keys + 1).count() <= BROADCAST_ROWS // keys


def ends(pairs: DataFrame) -> DataFrame:
    """``rep``: the classes of any pair."""
    return pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()


def sets(df: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``rep`` and its shingle set as bytes, for the wanted classes (``rep``, ``digest``); rows that repeat a class's text give its set again.

    Up to ``BROADCAST_ROWS`` wanted classes are sent to the texts; texts are shuffled only beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            found = X.text_sets(body, at, X.SPACED, k)
            own = [i for i, d in enumerate(batch.column("digest").to_pylist()) if digest(found[i]) == d]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(own, pa.int64())), pa.array([found[i].tobytes() for i in own], pa.binary())], names=["rep", "members"])

    asked = wanted.select(F.col("rep").alias("key"), "digest")
    docs = X.prepared(df, key, text).join(F.broadcast(asked) if few(asked) else asked, "key")
    return docs.mapInArrow(run, X.schema("rep bigint, members binary"))


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough.

    ``a``'s set travels once per salt and not once per pair: pairs are sorted by
    ``a`` and its set comes first. Where a key stands for several sets, one that is
    similar is enough. ``pairs`` should be written: they are read several times.
    """

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, []
        for batch in batches:
            found = []
            for a, b, members in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("members")):
                values = np.frombuffer(members.as_buffer(), np.uint64)
                if b is None:
                    own = [x for x in own if a == held and not np.array_equal(x, values)] + [values.copy()]
                    held = a
                elif a == held and any(similar(x, values) for x in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    if few(pairs, 2):  # then their ends are few as well, and need not be made distinct; beyond, the join below finds them too
        members = members.join(F.broadcast(pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))), "rep", "left_semi")
    elif few(asked := ends(pairs)):
        members = members.join(F.broadcast(asked), "rep", "left_semi")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_PAIRS)).cast("int").alias("salts"))
    others = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts").cast("bigint")).cast("int").alias("salt"), F.col("b").alias("rep"))
    leaders = salts.select("a", F.lit(None).cast("bigint").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("rep"))
    rows = others.unionByName(leaders).join(members, "rep").select("a", "b", "salt", "members")
    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(run, X.schema("a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of all nodes with a link but the smallest ones, by large-star and small-star steps.

    They end when every node hangs on one other and nothing hangs on it. ``links`` are read twice in the first round.
    """
    up, down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = links.where(F.col("a") != F.col("b")).select(up, down)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = edges.join(least, F.col("v") == F.col("at")).select("u", F.col("m").alias("v"))
        # neighbours larger than a node go to its smallest neighbour; then each node and its smaller neighbours to the smallest of them
        turned = large.where(F.col("u") != F.col("v"))
        lowest = turned.groupBy("u").agg(F.min("v").alias("m"))
        small = turned.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = X.written(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        # of each node, on how many it hangs and how many hang on it
        ends_of = edges.select(F.col("u").alias("node"), F.lit(1).alias("on")).union(edges.select("v", F.lit(0)))
        if not ends_of.groupBy("node").agg(F.sum("on").alias("on"), F.count(F.lit(1)).alias("all")).where("on > 0 AND all > 1").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
