"""Removal of repeated passages with suffix arrays of shards.

A byte is removed if it lies in a string of ``length`` bytes that also starts
earlier: in a document with a smaller key, or earlier in the same one. Strings
never cross documents and are judged on the input.

*Sharding.* Suffixes that can repeat must meet. Every window of ``length`` bytes
has a mark, the smallest hash of its ``GRAM``-byte strings; equal windows have
equal marks. A document is cut into pieces, maximal runs of windows with one
mark, so neighbouring pieces overlap by a window less a byte.

1. Pieces are sorted by mark and content (as hashes, without their texts). A
   piece whose content has come earlier is removed whole. A mark with only one
   content, in which the mark's string occurs once, can repeat nowhere; most of
   the table ends here.
2. The other marks' different pieces fetch their bytes and are dealt by mark into
   shards; a mark with many of them is spread over several shards.
3. In each shard, a suffix array of all bytes is made by prefix doubling with
   Larsson and Sadakane's refinement: after a sort by the first eight bytes only
   groups that are still equal are sorted again, by the rank ``h`` bytes on.
   Kasai's recurrence gives the common prefixes of neighbours, many stretches of
   the text side by side. Runs that share ``length`` bytes are equal windows; all
   but the earliest are removed.
4. For marks in several shards, each shard's distinct windows are merged: sorted
   by content, each run of equal ones is found by binary search, and all but the
   earliest are removed.

Spans are merged per document and cut out of its bytes. Only figures, spans and
the contested pieces are shuffled, and whole texts twice, by key.

Null texts count as empty. Texts shorter than ``length`` keep all bytes. A
missing key counts as the smallest. Rows that repeat a key and a text are the
same document; different texts under one key are ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import texts as X

LENGTH = 100
GRAM = 24
LONGEST = 1 << 16  # bytes of a piece; longer runs are cut, with an overlap
SHARD_BYTES = 1 << 20  # bytes of one suffix array; a mark's pieces beyond it are spread
LANES = 2048  # stretches of a text on which Kasai's recurrence runs side by side


def _marks(body: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """All pieces of the texts: mark, hash of the content, start and end in ``body``, whether the mark's string occurs twice."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    n = len(body)
    if n < length:
        return none
    prefix = X.sums(body, X.EXACT)
    starts = np.arange(n - gram + 1)
    hashes = least = X.spans_hash(prefix, starts, starts + gram)
    reach, size = length - gram + 1, 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
    room = np.repeat(at[1:], np.diff(at))
    window = np.flatnonzero(np.arange(len(least)) + length <= room[: len(least)])
    if not len(window):
        return none
    mark = least[window]
    new = np.ones(len(window), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (window[1:] != window[:-1] + 1) | (room[window[1:]] != room[window[:-1]])
    first = np.flatnonzero(new)
    mark, begin, end = mark[first], window[first], np.append(window[first[1:] - 1], window[-1]) + length
    long = np.flatnonzero(end - begin > LONGEST)
    if len(long):
        step = LONGEST - length + 1
        many = np.ones(len(mark), np.int64)
        many[long] = -(-(end[long] - begin[long] - length + 1) // step)
        row = np.repeat(np.arange(len(mark)), many)
        part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        mark, end = mark[row], end[row]
        begin = begin[row] + part * step
        end = np.minimum(end, begin + LONGEST)
    inside = end - begin - gram + 1
    upto = np.cumsum(inside) - inside
    own = hashes[np.arange(int(inside.sum())) + np.repeat(begin - upto, inside)] == np.repeat(mark, inside)
    return mark, X.spans_hash(prefix, begin, end), begin, end, np.add.reduceat(own.astype(np.int32), upto) > 1


_ID = "key bigint, own bigint"
_PIECE = f"mark bigint, content bigint, {_ID}, start bigint, size bigint, twice boolean"
_NAMES = ["mark", "content", "key", "own", "start", "size", "twice"]


def _pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in X.steps(batches):
            mark, content, begin, end, twice = _marks(body, at, length, gram)
            text = np.searchsorted(at, begin, "right") - 1
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark.view(np.int64)), pa.array(content.view(np.int64)), batch.column("key").take(row), batch.column("own").take(row), pa.array(begin - at[text]), pa.array(end - begin), pa.array(twice)],
                names=_NAMES,
            )

    return docs.mapInArrow(run, X.schema(_PIECE))


def _sifted(pieces: DataFrame) -> DataFrame:
    """Pieces that have come earlier (``again``) and the different pieces of marks that have several (not ``again``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the mark at hand, its content, the place of that content's first piece, and the mark's first piece while it is the only content
        mark = content = place = waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES]
            m, c = cols[0], cols[1]
            new_content = np.ones(len(m), bool)
            new_content[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
            new_mark = np.ones(len(m), bool)
            new_mark[1:] = m[1:] != m[:-1]
            if mark is not None:
                new_mark[0] = m[0] != mark
                new_content[0] = new_mark[0] or c[0] != content
            run_of = np.cumsum(new_content) - 1  # -1: the content goes on from the batch before
            heads = np.flatnonzero(new_content)
            where = np.stack([cols[i] for i in (2, 3, 4)])
            first = where[:, heads[run_of]] if len(heads) else np.zeros_like(where)
            if len(heads) < len(m) and run_of[0] < 0:
                first[:, run_of < 0] = np.array(place)[:, None]
            again = ~new_content & (where != first).any(axis=0)
            # different contents of a mark: a head is contested unless it is the only one so far
            order = np.cumsum(new_mark)
            several = np.zeros(len(heads), bool)
            if len(heads):
                group = order[heads]
                several[1:] |= group[1:] == group[:-1]
                several[:-1] |= group[:-1] == group[1:]
                if not new_mark[heads[0]]:  # the batch before had contents of this mark
                    several[0] = True
                several |= cols[6][heads]  # the piece may repeat itself
            out = []
            if waiting is not None and len(heads) and not new_mark[heads[0]]:
                out.append([np.array([x]) for x in waiting])
                waiting = None
            contested = heads[several]
            if len(heads):
                last = heads[-1]
                waiting = None if several[-1] else [col[last] for col in cols]
                place = [int(x[last]) for x in where]
            mark, content = m[-1], c[-1]
            out.append([col[contested] for col in cols])
            joined = [np.concatenate(x) for x in zip(*out)]
            yield _batch(joined, False)
            if again.any():
                yield _batch([col[again] for col in cols], True)

    ordered = pieces.repartition("mark").sortWithinPartitions("mark", "content", "key", "own", "start")
    return ordered.mapInArrow(run, X.schema(f"{_PIECE}, again boolean"))


def _batch(columns: list[np.ndarray], again: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(columns[0]), again))], names=[*_NAMES, "again"])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The text's suffixes in order, by their positions; a zero byte in the text counts as larger than its end.

    Prefix doubling with the refinement of Larsson and Sadakane: positions that
    are alone in their group keep their rank, the others are sorted again by the
    rank of the position as far on as the group is sorted.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = (sorted_key[1:] != sorted_key[:-1]) | (order[1:] > n - 8) | (order[:-1] > n - 8)  # what the end cuts short is alone
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[n] = -1
    h = 8
    while True:
        tail = np.append(head[1:], True)
        open_at = np.flatnonzero(~(head & tail))  # places in groups of several
        if not len(open_at):
            break
        who = order[open_at]
        group = rank[who]
        ahead = rank[np.minimum(who + h, n)] + 1
        resorted = np.argsort(group * np.int64(n + 1) + ahead, kind="stable")
        who, group, ahead = who[resorted], group[resorted], ahead[resorted]
        order[open_at] = who
        split = np.ones(len(who), bool)
        split[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        head[open_at] = split
        rank[who] = np.maximum.accumulate(np.where(split, open_at, 0))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in the suffix array the bytes shared with the place before, ``most`` at most, by Kasai's recurrence.

    Going through the text, a position shares at least one byte less with its
    neighbour than the position before did. Stretches of the text are gone
    through side by side, each from nothing.
    """
    n = len(text)
    words = np.zeros(n + most + 16, np.uint64)
    padded = np.concatenate((text, np.zeros(most + 24, np.uint8)))
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(8 * i)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    lanes = min(LANES, max(1, n // 64))
    stride = -(-n // lanes)
    begin = np.arange(lanes) * stride
    shared = np.zeros(lanes, np.int64)
    out = np.zeros(n, np.int64)
    for step in range(stride):
        here = begin + step
        lane = np.flatnonzero(here < n)
        here = here[lane]
        other = before[here]
        got = np.where(other >= 0, np.maximum(shared[lane] - 1, 0), 0)
        at = np.flatnonzero((other >= 0) & (got < most))
        while len(at):
            differ = words[here[at] + got[at]] ^ words[other[at] + got[at]]
            same = differ == 0
            # equal low bytes: the trailing zero bits of the difference, in eights
            low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            got[at] += np.where(same, 8, low)
            at = at[same]
            at = at[got[at] < most]
        got = np.minimum(got, np.minimum(most, n - np.maximum(here, other)))
        shared[lane] = got
        out[here] = got
    return out[order]


def _windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the pieces: the piece, the start in it, and a number equal for equal windows."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order = suffix_array(text)
    kind = np.cumsum(common_prefixes(text, order, length) < length)
    base = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(parts)), sizes)[order]
    start = order - base[piece]
    whole = start + length <= sizes[piece]
    return piece[whole], start[whole], kind[whole]


_SPANS = f"{_ID}, start bigint, end bigint"
_FOUND = f"{_ID}, start bigint, end bigint, window binary"


def _shards(contested: DataFrame, length: int) -> DataFrame:
    """Repeated spans inside shards; and for marks in several shards (``salts`` > 1) each distinct window's earliest place."""

    def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        piece, start, kind = _windows([r["bytes"] for r in rows], length)
        key, own, begin, salts = (np.array([r[c] for r in rows], np.int64) for c in ("key", "own", "start", "salts"))
        place = begin[piece] + start
        order = np.lexsort((place, own[piece], key[piece], kind))
        piece, start, place, kind = piece[order], start[order], place[order], kind[order]
        head = np.ones(len(kind), bool)
        head[1:] = kind[1:] != kind[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(kind)), 0))
        same = (key[piece] == key[piece[first]]) & (own[piece] == own[piece[first]]) & (place == place[first])
        again = np.flatnonzero(~same)
        yield _found(key[piece[again]], own[piece[again]], place[again], length, None)
        spread = np.flatnonzero(head & (salts[piece] > 1))
        if len(spread):
            windows = [rows[p]["bytes"][s : s + length] for p, s in zip(piece[spread].tolist(), start[spread].tolist())]
            yield _found(key[piece[spread]], own[piece[spread]], place[spread], length, [hashlib.blake2b(w, digest_size=16).digest() for w in windows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["mark"], row["salt"]
                if shard != last and size >= SHARD_BYTES:
                    yield from solve(held)
                    held, size = [], 0
                last = shard
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield from solve(held)

    ordered = contested.repartition("mark", "salt").sortWithinPartitions("mark", "salt")
    return ordered.mapInArrow(run, X.schema(_FOUND))


def _found(key: np.ndarray, own: np.ndarray, place: np.ndarray, length: int, windows: list[bytes] | None) -> pa.RecordBatch:
    """Windows as spans; without their contents, those that overlap are joined."""
    if windows is None and len(key):
        order = np.lexsort((place, own, key))
        key, own, place = key[order], own[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (place[1:] > place[:-1] + length)
        first = np.flatnonzero(new)
        end = place[np.append(first[1:] - 1, len(key) - 1)] + length
        key, own, place = key[first], own[first], place[first]
    else:
        end = place + length
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(place), pa.array(end), pa.array(windows if windows is not None else [None] * len(key), pa.binary())], names=["key", "own", "start", "end", "window"])


def _merged(windows: DataFrame) -> DataFrame:
    """Of equal windows from several shards all but the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            window = np.array(batch.column("window").to_pylist(), "S17")  # sorted; a byte more keeps trailing zeros apart
            cols = [batch.column(c).to_numpy() for c in ("key", "own", "start", "end")]
            values = np.unique(window)
            head = np.searchsorted(window, values)  # where each shard-crossing run begins
            first = head[np.searchsorted(values, window)]
            differs = np.zeros(len(window), bool)
            for col in cols[:3]:
                differs |= col != col[first]
            if window[0] == last:
                goes_on = window == last
                differs[goes_on] = ~((cols[0] == place[0]) & (cols[1] == place[1]) & (cols[2] == place[2]))[goes_on]
            if window[-1] != last:
                place = [col[first[-1]] for col in cols[:3]]
                last = window[-1]
            yield pa.RecordBatch.from_arrays([pa.array(col[differs]) for col in cols], names=["key", "own", "start", "end"])

    marked = windows.withColumn("window", F.concat("window", F.lit(b"\x01")))
    ordered = marked.repartition("window").sortWithinPartitions("window", "key", "own", "start")
    return ordered.mapInArrow(run, X.schema(_SPANS))


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The repeated spans, in bytes: ``key``, ``own`` (a hash of the text), ``start``, ``end``; they may overlap."""
    docs = _documents(df, key, text)
    sifted = X.written(_sifted(_pieces(docs, length, gram)))
    wanted = sifted.where(~F.col("again"))
    salts = wanted.groupBy("mark").agg(F.ceil(F.sum("size") / F.lit(SHARD_BYTES)).cast("int").alias("salts"))
    dealt = wanted.join(salts, "mark").withColumn("salt", F.pmod(F.xxhash64("content"), F.col("salts").cast("bigint")).cast("int"))
    body = F.col("text").cast("binary").substr(F.col("start").cast("int") + 1, F.col("size").cast("int"))
    contested = dealt.join(docs, ["key", "own"]).select("mark", "salt", "salts", "key", "own", "start", body.alias("bytes"))
    found = X.written(_shards(contested, length))
    spans = sifted.where("again").select("key", "own", "start", (F.col("start") + F.col("size")).alias("end"))
    inside = found.where(F.col("window").isNull()).select("key", "own", "start", "end")
    return spans.unionByName(inside).unionByName(_merged(found.where(F.col("window").isNotNull())))


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))
    return df.select(F.col(key).cast("long").alias("given"), named.alias("key"), F.xxhash64(whole).alias("own"), whole.alias("text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        spans = batch.column("spans")
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, own in zip(texts, spans):
            whole = text.as_py()
            out, at, removed, count = [], 0, 0, 0
            if own.is_valid:
                start, end = own.values.field(0).to_numpy(), own.values.field(1).to_numpy()
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > end[:-1]
                first = np.flatnonzero(new)
                for s, e in zip(start[first].tolist(), end[np.append(first[1:] - 1, len(start) - 1)].tolist()):
                    out.append(whole[at:s])
                    removed, at, count = removed + e - s, e, count + 1
            out.append(whole[at:])
            n_bytes.append(len(whole))
            n_removed.append(removed)
            n_spans.append(count)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("given"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["key", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row's ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes that are ``kept``."""
    spans = repeated(df, key, text, length, gram).groupBy("key", "own").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most as many as a text has bytes
    rows = _documents(df, key, text).join(spans, ["key", "own"], "left").select("given", "text", "spans")
    return rows.mapInArrow(_cut, X.schema("key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))
