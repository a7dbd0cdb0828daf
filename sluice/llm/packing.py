"""Best-fit packing of tokenized documents by matching the large ones first.

Documents are cut only where they are longer than a sequence. The plan is made
from the histogram of piece lengths, which has at most ``capacity`` entries
whatever the input: pieces above a third of the capacity pair at most twice per
sequence by greedy matching (the longest with the longest that still fits),
shorter ones go, longest first, into the smallest gap that holds them. The plan
is a list of runs: so many pieces of one length go to so many consecutive
sequences at one offset. Pieces are numbered by length in parallel, and each
finds its run by its number.

Null texts count as empty; an empty document is its end id alone. Rows with the
same or no key are packed like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.ranks import ordered_index
from sluice.llm import texts as X
from sluice.llm.tokens import END_ID, encoder, vocabulary

CAPACITY = 4096

PIECES = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: where it starts in the document's ids, its length and checksum."""
    path = path or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for batch, body, at in X.steps(batches):
            ids, sizes = encode(body, at)
            many = -(-sizes // capacity)  # every text has at least its end id
            row = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            begin = 4 * ((np.cumsum(sizes) - sizes)[row] + start)
            crc = [zlib.crc32(view[a : a + 4 * n]) for a, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32"],
            )

    return X.prepared(df, key, text).mapInArrow(cut, X.schema(PIECES))


Run = tuple[int, int, int, int, int]  # length, first rank of that length, pieces, first sequence, offset


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The runs of a packing of so many pieces of each length, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = defaultdict(int)  # pieces of a length placed so far
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: sequences, as (first, count)
    room: list[int] = []  # the gaps there are, ascending
    runs: list[Run] = []
    sequences = 0

    def place(n: int, count: int, first: int, offset: int) -> None:
        runs.append((n, used[n], count, first, offset))
        used[n] += count
        left[n] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0 and count:
            if not gaps[gap]:
                insort(room, gap)
            gaps[gap].append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    ascending = large[::-1]
    for n in large:
        while left[n]:
            fit = bisect_left(ascending, capacity - n + 1) - 1  # the longest that may stand beside n
            while fit >= 0 and left[ascending[fit]] == 0:
                ascending.pop(fit)
                fit -= 1
            mate = ascending[fit] if fit >= 0 else None
            pairs = 0 if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            if mate == n and not pairs:  # one is left and cannot stand beside itself
                mate = next((m for m in reversed(ascending[:fit]) if left[m]), None)
                pairs = 0 if mate is None else 1
            count = pairs or left[n]
            place(n, count, sequences, 0)
            if pairs:
                place(mate, pairs, sequences, n)
            leave(capacity - n - (mate if pairs else 0), sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            spot = bisect_left(room, n)
            if spot < len(room):
                gap = room[spot]
                first, there = gaps[gap].pop()
                count = min(there, left[n])
                if count < there:
                    gaps[gap].append((first + count, there - count))
                if not gaps[gap]:
                    room.pop(spot)
                place(n, count, first, capacity - gap)
                leave(gap - n, first, count)
                continue
            each = capacity // n
            full, rest = divmod(left[n], each)
            for j in range(each if full else 0):
                place(n, full, sequences, j * n)
            leave(capacity - each * n, sequences, full)
            sequences += full
            for j in range(rest):
                place(n, 1, sequences, j * n)
            if rest:
                leave(capacity - rest * n, sequences, 1)
                sequences += 1
    return runs, sequences


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with the sequence each goes to and its offset there. ``parts`` must be cheap to read twice."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    runs, _ = plan(histogram, capacity)
    before, total = {}, 0
    for n in sorted(histogram):
        before[n], total = total, total + histogram[n]
    table = np.array(sorted((before[n] + rank, first, offset) for n, rank, _, first, offset in runs), np.int64).reshape(-1, 3)
    begin, first, offset = (np.ascontiguousarray(table[:, i]) for i in range(3))

    names = parts.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column("at").to_numpy(zero_copy_only=False)
                run = np.searchsorted(begin, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(first[run] + at - begin[run]), pa.array(offset[run])],
                    names=[*names, "sequence_id", "offset"],
                )

    numbered = ordered_index(parts, ["length", "key", "piece", "ids_crc32"], "at")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return numbered.mapInArrow(assign, X.schema(f"{fields}, sequence_id bigint, offset bigint"))


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents of ``df`` packed into sequences of ``capacity`` ids."""
    return pack(X.written(pieces(df, key, text, path, capacity)), capacity)
