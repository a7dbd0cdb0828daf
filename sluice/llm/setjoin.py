"""Documents with similar word shingles, by a size-aware join: subsets of small sets, inverted lists of large ones.

A document's set holds its distinct word shingles (A-Z as a-z, words between
white space). Two documents are linked if the Jaccard similarity of their sets
reaches the threshold; the join is exact.

1. Shingles that occur often in a task's share of the texts are counted (at most
   ``COMMON`` of them go on). They come last in the order of all shingles, the
   others are in the order of their hashes. Any order is right, this one keeps
   lists short.
2. Documents with equal sets form a class. A set that overlaps another in ``o``
   members shares one of its first ``n - o + 1`` members with it, and a pair of
   its first ``n - o + 2``. So a small set (light) is entered under all pairs of
   its first members, fixed-size subsets of which two sets must share a whole one;
   a large set (heavy) under each of them, in an inverted list. Sets just below
   the boundary are entered both ways, so that they meet the heavy ones.
3. The boundary is the one of least cost among ``BOUNDARIES``: rows to shuffle for
   the entries, and meetings in the lists that are scanned.
4. Lists are cut by size: a set stays at home in the band of its own size and
   visits the next lower one, so that only sets that may be linked by their sizes
   meet. What is alone in its band goes.
5. Every list first pairs its members with one of them, ``HUBS`` times, as long as
   they are apart: first with the smallest class, then with others. A pair goes on
   if sizes and sketches allow a link, and is confirmed on the full sets. Links
   become components by alternating large-star and small-star steps. That is all
   for lists of two.
6. Longer lists that still hold several components are scanned: members outside a
   list's largest component meet all others, in blocks of both sides. Pairs that sketches
   cannot rule out are confirmed: first the most alike ones of a class and a
   component, then all that still lie apart. So a link can only be left out if it
   joins what is joined already.

Common shingles are dealt over salts, lists over blocks. The driver holds counts
and the common shingles, a bounded number.

Null texts, empty ones and those without words have an empty set and are linked
with nothing. Rows without a key are linked with nothing; their component is
null. Rows that repeat a key are judged by their own texts; where several texts
share the key that stands for a class, any of them makes a link. A very long text
is held alone by its task. An empty table gives no rows. Other columns are not
read, whatever their names. Ties: the smallest key names a class and a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import links as L
from sluice.llm import texts as X

COMMON = 1 << 17  # shingles that are put last in the order
OFTEN, CHUNK = 8, 1 << 22  # a shingle that occurs so often among so many is common
STEPS = 8  # levels of counts between a power of two and the next
SALT_ROWS = 4096  # rows of a common shingle that stay together
BOUNDARIES = (0, 8, 16, 32, 64, 128)  # sizes up to which sets may be light
ROW_COST = 8  # shuffling an entry against comparing two sketches
HUBS = 6
BLOCK = 4096  # members of a list, on each side, that meet in one task; they are compared some seekers at a time
PAIRS = 1 << 18  # pairs of members held at once
FIRST_TRIES = 16  # pairs of a class and a component that are confirmed before all others


def probes(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Of how many first members a set must share one with any linked set."""
    return n - -(-percent * n // 100) + 1


def indexed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The same for linked sets that are at least as large."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _common(df: DataFrame, key: str, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that are frequent in many texts, and their counts. Texts with equal sets within a chunk count once."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        many = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many], pa.int64())], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for _, body, at in X.steps(batches):
            for s in X.text_sets(body, at, X.SPACED, k):
                mark = (len(s), int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                if len(s) and mark not in seen:
                    seen.add(mark)
                    held.append(s)
                    size += len(s)
            if size >= CHUNK:
                yield often(held)
                held, size, seen = [], 0, set()
        yield often(held)

    counts = X.written(X.prepared(df, key, text).mapInArrow(run, X.schema("token bigint, n bigint")).groupBy("token").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * STEPS).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True)  # a few hundred rows at most
    taken = [r["level"] for r, total in zip(levels, np.cumsum([r["c"] for r in levels])) if total <= COMMON]
    top = counts.where(level >= min(taken, default=1 << 20)).toArrow()  # at most ``COMMON`` rows
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order].astype(np.int64)


class Order:
    """The order of all shingles: uncommon ones by hash, then common ones by count. And over how many salts each is dealt."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens = tokens
        self.rank = np.empty(len(tokens), np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(1, len(tokens) + 1)
        self.dealt = (-(-counts // SALT_ROWS)).astype(np.int32)

    def _at(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.tokens, members), len(self.tokens) - 1)
        return at, self.tokens[at] == members

    def first(self, members: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` of a sorted set."""
        if not len(self.tokens):
            return members[:most]
        at, common = self._at(members)
        return members[np.argsort(np.where(common, self.rank[at], 0), kind="stable")[:most]]

    def salts(self, members: np.ndarray) -> np.ndarray:
        """0 for uncommon shingles."""
        if not len(self.tokens):
            return np.zeros(len(members), np.int32)
        at, common = self._at(members)
        return np.where(common, self.dealt[at], 0).astype(np.int32)


def measured(df: DataFrame, order: Order, key: str, text: str, k: int, percent: int) -> DataFrame:
    """``key``, ``n`` (size of the set), ``digest`` (equal for equal sets; null for empty ones), ``sketch`` and ``head``, the set's first members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            found = X.text_sets(body, at, X.SPACED, k)
            some = lambda f: pa.array([f(s) if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([len(s) for s in found], pa.int64()),
                    some(L.digest),
                    some(L.sketch),
                    some(lambda s: order.first(s, int(probes(len(s), percent)) + 1).tobytes()),
                ],
                names=["key", "n", "digest", "sketch", "head"],
            )

    return X.prepared(df, key, text).mapInArrow(run, X.schema("key bigint, n bigint, digest binary, sketch binary, head binary"))


def entries(classes: DataFrame, order: Order, percent: int, boundary: int, subsets: bool, lists: bool) -> DataFrame:
    """Where the classes are entered (``token``, ``mark``, ``rep``): light ones under pairs of their first members, those that meet heavy ones under single members.

    ``mark`` packs a salt with two bits: whether the token is dealt over salts, and
    whether the entry lies among the members that a linked set at least as large
    must share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for rep, n, head in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("head")):
                own = np.frombuffer(head.as_buffer(), np.uint64)
                p, q = int(probes(n, percent)), int(indexed(n, percent))
                salts = order.salts(own)
                if subsets and n <= boundary and len(own) >= 2:
                    i, j = np.triu_indices(len(own), 1)
                    pairs = X.joined_hash([np.minimum(own[i], own[j]), np.maximum(own[i], own[j])])
                    out.append(_entered(rep, pairs, np.minimum(salts[i], salts[j]), j < q + 1))
                if lists and 100 * n >= percent * boundary:
                    out.append(_entered(rep, own[:p], salts[:p], np.arange(min(p, len(own))) < q))
            token, mark, reps = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(mark.astype(np.int32)), pa.array(reps, pa.int64())], names=["token", "mark", "rep"])

    return classes.mapInArrow(run, X.schema("token bigint, mark int, rep bigint"))


def _entered(rep: int, tokens: np.ndarray, salts: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    salt = int(X.mixed(np.array([rep], np.int64).view(np.uint64))[0] >> np.uint64(33)) % np.maximum(salts, 1)
    return tokens, salt * 4 + (salts > 0) * 2 + small, np.full(len(tokens), rep, np.int64)


def _shared(rows: DataFrame) -> DataFrame:
    """The entries under tokens that several classes have, in one shuffle: sorted by token, lone ones go. Those dealt over salts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting = None, None  # the token whose next rows stay; the last row, if it stands alone so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            token, mark = batch.column("token").to_numpy(), batch.column("mark").to_numpy()
            same = token[1:] == token[:-1]
            keep = mark & 2 > 0
            keep[1:] |= same
            keep[:-1] |= same
            if kept is not None and token[0] == kept:
                keep[token == kept] = True
            waiting = None if keep[-1] else batch.slice(batch.num_rows - 1)
            kept = token[-1] if keep[-1] else None
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("token").filter(take), batch.column("rep").filter(take), pa.array((mark & 1)[keep] > 0)], names=["token", "rep", "small"])

    dealt = rows.repartition("token", F.shiftright("mark", 2)).sortWithinPartitions("token", "mark")
    return dealt.mapInArrow(run, X.schema("token bigint, rep bigint, small boolean"))


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``n`` in lists that are cut by size; ``home`` tells that a set belongs to the band and does not visit it."""
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)  # sets that may be linked are at most one band apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    stays = F.struct(band.alias("band"), F.lit(True).alias("home"))
    visits = F.struct((band - 1).alias("band"), F.lit(False).alias("home"))
    spread = rows.select("token", "rep", "n", "small", F.inline(F.array(stays, visits))).withColumn("token", F.xxhash64("token", "band")).drop("band")
    written = X.written(spread)
    lists = written.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max("home").alias("inhabited")).where("c > 1 AND inhabited")
    return written.join(lists.select("token"), "token", "left_semi")


def boundary(classes: DataFrame, order: Order, percent: int) -> int:
    """The size up to which sets are light, by the cost of entering and scanning the smaller sets."""
    most = BOUNDARIES[-1]
    small = classes.where(F.col("n") <= most)
    names = BOUNDARIES[1:]
    lists = entries(small, order, percent, 0, subsets=False, lists=True).join(small.select("rep", "n"), "rep")
    within = lambda b, a: (F.col("n") <= b) & (F.col("n") > a)
    per_list = lists.groupBy("token").agg(F.count(F.lit(1)).alias("all"), *[F.count_if(within(b, a)).alias(f"c{b}") for a, b in zip(BOUNDARIES, names)])
    scans = per_list.agg(*[F.coalesce(F.sum(F.col(f"c{b}") * (F.col("all") - 1)), F.lit(0)).alias(f"c{b}") for b in names]).first()
    sizes = {r["n"]: r["c"] for r in small.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most ``most`` rows

    def cost(light: int) -> int:
        pairs = sum(c * (p + 1) * p // 2 for n, c in sizes.items() if n <= light for p in [int(probes(n, percent))])
        single = sum(c * int(probes(n, percent)) for n, c in sizes.items() if 100 * n >= percent * light)
        return ROW_COST * (pairs + single) + sum(scans[f"c{b}"] for b in names if b > light)

    return min(BOUNDARIES, key=lambda b: (cost(b), b))


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = L.sketches(batch.column("sketch_a")), L.sketches(batch.column("sketch_b"))
                keep = pa.array(L.possible(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, X.schema("a bigint, b bigint"))


def _starred(rows: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs of every list's hub and its members that lie apart from it. ``rows`` with ``component``."""
    place = F.col("rep") if number == 0 else F.xxhash64("rep", F.lit(number))
    hubs = rows.groupBy("token").agg(F.min(F.struct(place.alias("place"), "rep", "n", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = hubs.where(F.col("low") != F.col("high")).select("token", "hub")
    met = rows.join(mixed, "token").where((F.col("component") != F.col("hub")["component"]) & (100 * F.least("n", F.col("hub")["n"]) >= percent * F.greatest("n", F.col("hub")["n"])))
    return met.select(F.col("hub")["rep"].alias("a"), F.col("rep").alias("b")).distinct()


def _dealt(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of lists with several components, dealt over blocks ``x`` of seekers and ``y`` of those that they meet.

    Seekers lie outside a list's largest component. A member goes to one block for every ``BLOCK`` of the other side.
    """
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    per_list = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    mixed = per_list.where(F.col("parts") > 1).select(
        "token", F.col("top")["component"].alias("main"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("top")["c"]).alias("seekers")
    )
    active = rows.join(mixed, "token").join(classes.select("rep", "sketch"), "rep").withColumn("free", F.col("component") != F.col("main"))
    place = lambda c: F.pmod(F.xxhash64("rep"), F.col(c).cast("bigint")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    fields = ["free", "home", "rep", "n", "small", "component", "sketch"]
    met = active.select("token", every("seekers").alias("x"), place("blocks").alias("y"), F.lit(False).alias("seeks"), *fields)
    seeking = active.where("free").select("token", place("seekers").alias("x"), every("blocks").alias("y"), F.lit(True).alias("seeks"), *fields)
    return met.unionByName(seeking)


def _crossing(rows: DataFrame, classes: DataFrame, percent: int, first: bool) -> DataFrame:
    """Pairs of a list in different components that may be linked.

    The ``first`` time the ``FIRST_TRIES`` most alike ones of each class and component, the second time all
    that still lie apart. ``cut`` tells that a pair's class had more.
    """
    group = ["token", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # rows of the group that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            starts = _starts(batch, group)
            waiting = batch.slice(starts[-1])
            if starts[-1]:
                yield from _met(batch.slice(0, starts[-1]), starts[:-1], percent, FIRST_TRIES if first else None)
        if waiting is not None:
            yield from _met(waiting, np.zeros(1, np.int64), percent, FIRST_TRIES if first else None)

    ordered = _dealt(rows, classes).repartition(*group).sortWithinPartitions(*group, F.desc("seeks"))
    found = ordered.mapInArrow(run, X.schema("a bigint, b bigint, cut boolean"))
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cut").alias("cut"))


def _starts(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Where a new group begins in sorted rows."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = np.any([(v := batch.column(c).to_numpy())[1:] != v[:-1] for c in group], axis=0)
    return np.flatnonzero(new)


def _met(batch: pa.RecordBatch, starts: np.ndarray, percent: int, tries: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of all groups that sizes, places and sketches do not rule out, some seekers at a time. Seekers stand first in a group."""
    seeks, free, small, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seeks", "free", "small", "home"))
    rep, size, component = (batch.column(c).to_numpy() for c in ("rep", "n", "component"))
    marks = L.sketches(batch.column("sketch"))
    ends = np.append(starts[1:], batch.num_rows)
    askers = np.add.reduceat(seeks.astype(np.int64), starts)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    mine = np.flatnonzero(seeks)
    others = (ends - starts - askers)[group[mine]]  # how many each seeker meets, and where they start
    begin = (starts + askers)[group[mine]]
    for low, high in _cuts(others):
        count = others[low:high]
        i = np.repeat(mine[low:high], count)
        j = np.repeat(begin[low:high], count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        n, m = size[i], size[j]
        fit = (component[i] != component[j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        fit &= ~free[j] | (rep[j] > rep[i])  # a pair that seeks on both sides comes from the smaller
        fit &= (small[j] | (m > n)) & (small[i] | (n > m)) & (home[i] | home[j])  # two visitors meet at home
        i, j = i[fit], j[fit]
        near = L.possible(marks[i], marks[j], size[i], size[j], percent)
        i, j = i[near], j[near]
        unlike = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64) / (size[i] + size[j])
        i, j, cut = L.most_alike(i, j, unlike, component, rep, tries)  # all that a seeker meets in a group is at hand
        yield pa.RecordBatch.from_arrays([pa.array(rep[i], pa.int64()), pa.array(rep[j], pa.int64()), pa.array(cut, pa.bool_())], names=["a", "b", "cut"])


def _cuts(counts: np.ndarray, most: int = PAIRS) -> Iterator[tuple[int, int]]:
    """Runs of seekers that meet at most ``most`` others together, one seeker at least."""
    upto = np.cumsum(counts)
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable by links)."""
    percent = round(threshold * 100)
    if not 50 < percent <= 100:
        raise ValueError("the threshold must lie above 0.5, so that linked sets that differ share two members")
    order = Order(*_common(df, key, text, k))
    whole = X.written(measured(df, order, key, text, k, percent))
    known = whole.where(F.col("digest").isNotNull() & F.col("key").isNotNull())
    grouped = known.groupBy("digest").agg(F.min(F.struct("key", "n", "sketch", "head")).alias("s"))
    headed = X.written(grouped.select("digest", F.col("s")["key"].alias("rep"), *[F.col("s")[c].alias(c) for c in ("n", "sketch", "head")]))
    every = X.written(whole.select("key", "n", "digest"))
    X.forget(whole)
    light = boundary(headed, order, percent)
    lists = _shared(entries(headed, order, percent, light, subsets=True, lists=True))
    rows = X.written(_banded(lists.join(headed.select("rep", "n").distinct(), "rep"), percent))
    classes = X.written(headed.drop("head"))
    X.forget(headed)
    joined = _joined(df, classes, rows, key, text, k, percent)
    named = classes.select("digest", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        every.join(named, "digest", "left")
        .select("key", F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))
    )


def _joined(df: DataFrame, classes: DataFrame, rows: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """``node`` and ``component`` of all classes that are linked with a smaller one."""
    none = classes.select("rep", F.lit(b"").alias("members")).where("false")
    edges = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    members, have, tested = none, none.select("rep"), edges
    joined = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The components after the pairs that are new and confirmed. Sets are taken from the texts when a pair first asks for them."""
        nonlocal members, have
        fresh = X.written(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"))
        asked = X.written(L.ends(fresh).join(have, "rep", "left_anti"))
        if asked.limit(1).count():
            wanted = X.written(classes.select("rep", "digest").join(asked, "rep", "left_semi"))
            members = members.union(X.written(L.sets(df, wanted, key, text, k)))
            have = have.union(asked)
        more = X.written(L.confirmed(fresh, members, percent))
        if not more.limit(1).count():
            return joined
        return L.components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    def named() -> DataFrame:  # of the lists that are left
        return rows.join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")

    for number in range(HUBS):
        pairs = X.written(_alike(_starred(named(), number, percent), classes, percent))
        if pairs.limit(1).count():
            joined, tested = confirm(pairs), tested.union(pairs)
        if not number:  # a list of two has been looked at
            rows = X.written(rows.join(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 2").select("token"), "token", "left_semi"))
    for first in (True, False):
        crossing = X.written(_crossing(named(), classes, percent, first))
        joined, tested = confirm(crossing), tested.union(crossing.select("a", "b"))
        if not crossing.where("cut").limit(1).count():
            break
    return joined
