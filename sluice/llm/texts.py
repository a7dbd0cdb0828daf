"""Whole texts of Arrow batches as byte arrays: words, word hashes and shingles, without a Python loop per word.

A batch's texts lie one after the other in one byte array. Words never run from
one text into the next. A null text counts as an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import checkpoint_dir

STEP_BYTES = 1 << 20  # bytes of text handled at once; one longer text is a step of its own

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229)
_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED = _CODES.copy()
FOLDED[65:91] = FOLDED[97:123]  # A-Z hash like a-z
EXACT = _CODES

SPACED = np.ones(256, bool)  # words between white space
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)  # digits, letters and whatever is not ASCII
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only ``key`` as a long and ``text`` as a string, whatever other columns there are."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def written(df: DataFrame) -> DataFrame:
    """``df`` written into the cluster's shared folder and read back: computed once, safe from lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`written` gave, once nothing will read it again."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and where each starts (one more entry than texts)."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    if len(wide) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most ``limit`` bytes of text, each with its bytes and starts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        body, at = raw(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), body[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def words(body: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of ``kind``, and the first word of each text (one more entry than texts)."""
    n = len(body)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = kind[body]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, at)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cached: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` modulo 2**64 up to ``n``; kept for the usual step size."""
    if base not in _cached or len(_cached[base]) <= n:
        found = _powers(base, max(n, STEP_BYTES))
        if n > 4 * STEP_BYTES:
            return found
        _cached[base] = found
    return _cached[base]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sums(body: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; one more entry than bytes."""
    out = np.zeros(len(body) + 1, np.uint64)
    values = codes[body]
    values *= powers(_BASE, len(body))[: len(body)]
    np.cumsum(values, out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from :func:`sums`."""
    h = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = FOLDED) -> np.ndarray:
    """One 64-bit hash per word; with the default codes A-Z count as a-z."""
    return spans_hash(sums(body, codes), starts, ends)


_STEPS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def joined_hash(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence from the hashes of its members."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for i, part in enumerate(parts):
        h = mixed(h * _STEPS[i % 4] + part)
    return h


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of one text's ``k``-word shingles; the whole sequence as one if it is shorter."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < k:
        return joined_hash([hashes[i : i + 1] for i in range(len(hashes))])
    return np.unique(joined_hash([hashes[i : len(hashes) - k + 1 + i] for i in range(k)]))


def text_sets(body: np.ndarray, at: np.ndarray, kind: np.ndarray, k: int) -> list[np.ndarray]:
    """The shingle set of every text."""
    starts, ends, first = words(body, at, kind)
    h = word_hashes(body, starts, ends)
    return [shingles(h[first[i] : first[i + 1]], k) for i in range(len(at) - 1)]


def held_out(key: Column) -> Column:
    """Rows no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
