"""Near-duplicate documents by MinHash: many universal hash minima, banding, signatures, confirmed links and their components.

A document's set holds its distinct word shingles (A-Z as a-z, words between
white space). Two documents are linked if the Jaccard similarity of their sets
reaches the threshold.

1. Documents with equal sets form a class; only the class's smallest key goes on.
2. Each set gets ``MINIMA`` minima under universal hash functions, its signature.
   Equal rows of a band put two classes into one bucket. A pair at similarity 0.8
   misses all buckets with a probability of 6e-7, and its signatures agree too
   little with one of 1e-5.
3. In every bucket each class is paired with the smallest one (a star, never all
   pairs). Pairs whose signatures agree enough are confirmed on the full sets.
4. Links become components by alternating large-star and small-star steps.
5. Buckets that still hold several components are looked at again: the classes
   outside a bucket's largest component are compared, by signature and sketch,
   with all others of the bucket, in blocks of both sides. Pairs that agree enough
   and lie in different components are confirmed: first the most similar ones of
   each class and component, then all that still lie apart. So a link between
   classes that meet in a bucket can only be left out if it joins what is joined
   already. Sketches rule out nearly all pairs just below the threshold, and never
   a link, so that what is confirmed follows the classes and not their pairs.

Nothing passes the driver but counts. A class in very many pairs is spread over
salts, a bucket over blocks.

Null texts, empty ones and those without words have an empty set and are linked
with nothing. Rows without a key are linked with nothing; their component is
null and they are kept. Rows that repeat a key are judged by their own texts; where
several texts share the key that stands for a class, any of them makes a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import links as L
from sluice.llm import texts as X
from sluice.llm.links import components

BANDS, ROWS = 36, 5
MINIMA = 360  # the first BANDS * ROWS make buckets, all of them make estimates
SLACK = 0.09  # more than four deviations of an estimate from 360 minima at 0.8
BLOCK = 256  # classes of a bucket compared in one go
FIRST_TRIES = 16  # pairs of a class and a component that are confirmed before all others
_RANDOM = np.random.default_rng(36 * 5)
_A = _RANDOM.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest values of a set under every hash function, as 8 of their bits after mixing.

    Two different values agree by chance once in 256; that adds a thousandth to an estimate near 0.8.
    """
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for low in range(0, len(shingles), 2048):
        np.minimum(least, (_A * shingles[low : low + 2048] + _B).min(axis=1), out=least)
    return (X.mixed(least) >> np.uint64(56)).astype(np.uint8)


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """``key``, ``n`` (size of the set), ``digest`` (equal for equal sets; null for empty ones), ``sig`` and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            sets = X.text_sets(body, at, X.SPACED, k)
            digests = [L.digest(s) if len(s) else None for s in sets]
            found = [minima(s).tobytes() if len(s) else None for s in sets]
            marks = [L.sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, found, marks))],
                names=["key", "n", "digest", "sig", "sketch"],
            )

    return X.prepared(df, key, text).mapInArrow(run, X.schema("key bigint, n bigint, digest binary, sig binary, sketch binary"))


def _bands(classes: DataFrame) -> DataFrame:
    """One row per class and band: the bucket it falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, MINIMA)[:, : BANDS * ROWS].reshape(-1, ROWS).astype(np.uint64)
                band = np.tile(np.arange(BANDS, dtype=np.uint64), batch.num_rows)
                bucket = X.joined_hash([sig[:, i] + (band << np.uint64(32)) for i in range(ROWS)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(band.astype(np.int32)), *(pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("rep", "n"))],
                    names=["bucket", "band", "rep", "n"],
                )

    return classes.mapInArrow(run, X.schema("bucket bigint, band int, rep bigint, n bigint"))


def _agreeing(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose signatures agree enough and whose sketches do not rule them out."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                keep = (a == b).mean(axis=1) >= threshold - SLACK
                keep = pa.array(keep & L.possible(L.sketches(batch.column("sketch_a")), L.sketches(batch.column("sketch_b")), n, m, percent))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    side = lambda s: classes.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "sig", "sketch")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{s}" for c in ("n", "sig", "sketch") for s in "ab"])
    return met.mapInArrow(run, X.schema("a bigint, b bigint"))


def _crossing(rows: DataFrame, classes: DataFrame, threshold: float, first: bool) -> DataFrame:
    """Pairs of a bucket in different components whose signatures agree.

    The ``first`` time the ``FIRST_TRIES`` most similar ones of each class and
    component, the second time all that still lie apart, whichever side seeks by then.

    A pair that meets in several buckets comes from the one of its first band.
    ``rows``: ``bucket``, ``band``, ``rep``, ``n``, ``component``. ``cut`` tells that a pair's class had more.
    """
    percent = round(threshold * 100)
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    per_bucket = sizes.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    mixed = per_bucket.where(F.col("parts") > 1).select(
        "bucket", F.col("top")["component"].alias("main"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("top")["c"]).alias("seekers")
    )
    # a class brings its signature to all its mixed buckets (at most one a band) in one joined row, and goes on to blocks from there
    own = rows.join(mixed, "bucket").groupBy("rep").agg(F.collect_list(F.struct("bucket", "band", "n", "component", "main", "blocks", "seekers")).alias("own"))
    active = own.join(classes.select("rep", "sig", "sketch"), "rep").select("rep", "sig", "sketch", F.inline("own")).withColumn("free", F.col("component") != F.col("main"))
    place = lambda c: F.pmod(F.xxhash64("rep"), F.col(c).cast("bigint")).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    at = lambda x, y, seeks: F.struct(x.alias("x"), y.alias("y"), F.lit(seeks).alias("seeks"))
    met = F.transform(every("seekers"), lambda x: at(x, place("blocks"), False))
    seeking = F.transform(F.when(F.col("free"), every("blocks")).otherwise(F.array().cast("array<int>")), lambda y: at(place("seekers"), y, True))
    dealt = active.select("bucket", F.inline(F.concat(met, seeking)), "free", "band", "rep", "n", "component", "sig", "sketch")

    def block(table: pa.Table) -> pa.Table:
        seeks, free = table.column("seeks").to_numpy(), table.column("free").to_numpy()
        rep, size, component = (table.column(c).to_numpy() for c in ("rep", "n", "component"))
        band = table.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(rep), -1)
        marks = L.sketches(table.column("sketch").combine_chunks())
        mine, others = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        fit = component[mine][:, None] != component[others][None]
        fit &= ~free[others][None] | (rep[others][None] > rep[mine][:, None])  # a pair that seeks on both sides comes from the smaller
        fit &= np.minimum(size[mine][:, None], size[others][None]) >= threshold * np.maximum(size[mine][:, None], size[others][None])
        i, j = np.nonzero(fit)
        i, j = mine[i], others[j]
        near = L.possible(marks[i], marks[j], size[i], size[j], percent) if len(i) else np.zeros(0, bool)
        i, j = i[near], j[near]
        equal = sig[i] == sig[j]
        share = equal.mean(axis=1) if len(i) else np.zeros(0)
        near = (share >= threshold - SLACK) & (equal[:, : BANDS * ROWS].reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1) == band)
        i, j, cut = L.most_alike(i[near], j[near], -share[near], component, rep, FIRST_TRIES if first else None)
        return pa.table([pa.array(rep[i], pa.int64()), pa.array(rep[j], pa.int64()), pa.array(cut, pa.bool_())], names=["a", "b", "cut"])

    found = dealt.groupBy("bucket", "x", "y").applyInArrow(block, X.schema("a bigint, b bigint, cut boolean"))
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cut").alias("cut"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable), ``kept`` (the component's smallest key)."""
    every = X.written(signatures(df, key, text, k))
    known = every.where(F.col("digest").isNotNull() & F.col("key").isNotNull())
    grouped = known.groupBy("digest").agg(F.min(F.struct("key", "n", "sig", "sketch")).alias("s"))
    classes = X.written(grouped.select("digest", F.col("s")["key"].alias("rep"), *[F.col("s")[c].alias(c) for c in ("n", "sig", "sketch")]))
    joined = _joined(df, classes, key, text, k, threshold)
    named = classes.select("digest", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        every.join(named, "digest", "left")
        .select("key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
        .withColumn("component_id", F.when(F.col("key").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))
    )


def _joined(df: DataFrame, classes: DataFrame, key: str, text: str, k: int, threshold: float) -> DataFrame:
    """``node`` and ``component`` of all classes that are linked with a smaller one."""
    banded = _bands(classes)
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rep", "n")).alias("s")).where(F.col("c") > 1)
    rows = X.written(banded.join(shared.select("bucket", F.col("s")["rep"].alias("first"), F.col("s")["n"].alias("first_n")), "bucket"))
    alike = (F.least("n", "first_n") >= F.greatest("n", "first_n") * threshold) & (F.col("rep") != F.col("first"))
    stars = rows.where(alike).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = classes.select("rep", "digest").join(rows.select("rep").distinct(), "rep", "left_semi")
    sets = X.written(L.sets(df, wanted, key, text, k))
    percent = round(threshold * 100)
    links = X.written(L.confirmed(X.written(_agreeing(stars, classes, threshold)), sets, percent))
    joined = components(links)
    tested = stars
    for first in (True, False):
        named = rows.join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
        met = _crossing(named.select("bucket", "band", "rep", "n", "component"), classes, threshold, first)
        crossing = X.written(met.join(tested.withColumn("known", F.lit(True)), ["a", "b"], "left"))
        fresh = crossing.where("known IS NULL").select("a", "b")
        more = X.written(L.confirmed(fresh, sets, percent))
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        if not crossing.where("cut").limit(1).count():
            break
        tested = tested.union(crossing.select("a", "b"))
    return joined
