"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and texts are words of letters, digits and non-ASCII characters, A-Z as
a-z. All items go into one automaton over words. A text is streamed through it:
after each word the automaton holds the longest match that ends there. A word is
hit if it lies inside an occurrence of a window, which is any ``window`` words
of an item in a row, or a whole item that is shorter. Words that no item has
reset the automaton, so stretches of known words are found first, on whole
arrays, and only those long enough to hold a window are streamed.

Null texts and texts without words have no hits; items without words are no
windows. Copies of an item are items of their own. Items are held in memory by
every task: their bytes are checked against ``MAX_ITEM_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import texts as X

WINDOW = 13
MAX_ITEM_BYTES = 64 << 20


class Automaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        """``items``: id and word hashes."""
        self.window = window
        vocabulary = np.unique(np.concatenate([h for _, h in items if len(h)] or [np.zeros(0, np.uint64)]))
        self.vocabulary = vocabulary
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(name, np.searchsorted(vocabulary, h).tolist()) for name, h in items if len(h)]
        self.shortest = min([window, *(len(w) for _, w in texts)]) if texts else 0
        for _, words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        holds: list[dict[int, set[str]]] = [{} for _ in self.link]  # by length, the items whose windows this state stands for
        for name, words in texts:
            state, size = 0, 0
            span = min(window, len(words))
            for w in words:
                state, size = self.step(state, size, w)
                while size > span and self.length[self.link[state]] >= span:
                    state = self.link[state]
                    size = self.length[state]
                if size >= span:
                    holds[state].setdefault(span, set()).add(name)
        self.holds = holds

    def _extend(self, last: int, w: int) -> int:
        following, link, length = self.next, self.link, self.length
        if w in following[last]:
            q = following[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        state = len(link)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in following[p]:
            following[p][w] = state
            p = link[p]
        if p >= 0:
            q = following[p][w]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return state

    def _clone(self, p: int, w: int, q: int) -> int:
        following, link, length = self.next, self.link, self.length
        copy = len(link)
        following.append(dict(following[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and following[p].get(w) == q:
            following[p][w] = copy
            p = link[p]
        return copy

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """The longest match after one more word."""
        following, link, length = self.next, self.link, self.length
        while w not in following[state]:
            state = link[state]
            if state < 0:
                return 0, 0
            size = length[state]
        return following[state][w], size + 1

    def stream(self, words: list[int]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        state = size = 0
        for i, w in enumerate(words):
            state, size = self.step(state, size, w)
            at, most = state, size
            while at > 0 and most >= self.shortest:  # states of shorter and shorter matches that end here
                for span, names in self.holds[at].items():
                    if most >= span:
                        found.update(names)
                        hit[i + 1 - span : i + 1] = True
                at = self.link[at]
                most = self.length[at]
        return hit, found


def _items(items: DataFrame, key: str, text: str) -> list[tuple[str, str]]:
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("b")).first()["b"]
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"{size} bytes of test items; an automaton is for {MAX_ITEM_BYTES} at most")
    rows = items.select(F.col(key).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit(""))).collect()
    return [(r[0], r[1]) for r in rows]


def automaton(items: list[tuple[str, str]], window: int = WINDOW) -> Automaton:
    body, at = X.raw(pa.array([t for _, t in items], pa.string()))
    starts, ends, first = X.words(body, at, X.ALNUM)
    h = X.word_hashes(body, starts, ends)
    return Automaton([("" if name is None else name, h[first[i] : first[i + 1]]) for i, (name, _) in enumerate(items)], window)


RESULT = "key bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>, kept string"


def scan(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per document: words, hit words, items found, hit spans (in bytes) and, if asked for, the text without them."""
    known = _items(items, item_key, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(known, window)  # built anew by each task, from the items in its closure
        vocabulary = auto.vocabulary
        for batch, body, at in X.steps(batches):
            starts, ends, first = X.words(body, at, X.ALNUM)
            h = X.word_hashes(body, starts, ends)
            n = len(at) - 1
            counts = np.diff(first)
            hits, items_of, spans = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            if len(vocabulary) and len(h):
                number = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                inside = vocabulary[number] == h
                for a, b in _stretches(inside, first, auto.shortest):
                    hit, found = auto.stream(number[a:b].tolist())
                    if found:
                        row = int(np.searchsorted(first, a, "right")) - 1
                        hits[row] += int(hit.sum())
                        items_of[row] += found
                        for s, e in _runs(hit):
                            spans[row].append((int(starts[a + s] - at[row]), int(ends[a + e - 1] - at[row])))
            view = body.tobytes() if keep_text else b""
            kept = [_without(view[at[i] : at[i + 1]], spans[i]).decode("utf-8", "replace") if keep_text else None for i in range(n)]
            pairs = [[{"start": s, "end": e} for s, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(counts),
                    pa.array(hits),
                    pa.array([sorted(set(x)) for x in items_of], pa.list_(pa.string())),
                    pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.string()),
                ],
                names=["key", "n_words", "n_hit", "items", "spans", "kept"],
            )

    return X.prepared(df, key, text).mapInArrow(run, X.schema(RESULT))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _stretches(inside: np.ndarray, first: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Runs of known words inside one text that are long enough to hold a window."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= shortest
    return list(zip(a[long].tolist(), b[long].tolist()))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one in ``share`` words is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def digest(found: DataFrame) -> DataFrame:
    """The scan as one row of figures per document."""
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
