"""Token ids of whole texts with a public tokenizer, at the cost of its distinct words.

The tokenizer ends every token at white space and between a letter and the
punctuation after it, so a text's ids are those of its chunks one after the
other. Distinct chunks are encoded once per worker and looked up by a 64-bit
hash; chunks that could hold a special token are always encoded anew.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from sluice.llm import texts as X

PLACE_BITS = 21  # a worker remembers up to 2**21 chunks
POOL_IDS = 8 << 20  # and so many ids; beyond it starts anew
END_ID = 1

_BREAKS = np.ones(256, bool)
_BREAKS[[32, 9, 10, 13]] = False
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True
_PLAIN = np.zeros(256, bool)  # bytes after which a mark is a chunk of its own
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True


def _byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def chunks(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces whose ids do not depend on what is around them, and the first piece of each text.

    Pieces are split at white space, and before marks that close a piece right
    after an ASCII letter or digit or an accented Latin letter.
    """
    starts, ends, first = X.words(body, at, _BREAKS)
    if len(starts) == 0:
        return starts, ends, first
    last = body[ends - 1]
    before = body[np.maximum(ends - 2, 0)]
    lead = body[np.maximum(ends - 3, 0)]
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (ends - starts >= 3)
    cut = _MARKS[last] & (ends - starts >= 2) & (_PLAIN[before] | latin)
    cut &= ~_has(body, starts, ends)
    extra = np.cumsum(cut)
    spot = np.arange(len(starts)) + extra - cut
    total = len(starts) + int(extra[-1])
    s, e = np.empty(total, np.int64), np.empty(total, np.int64)
    s[spot], e[spot] = starts, ends - cut
    marks = np.flatnonzero(cut)
    s[spot[marks] + 1], e[spot[marks] + 1] = ends[marks] - 1, ends[marks]
    grown = np.concatenate(([0], extra))
    return s, e, first + grown[first]


def _has(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pieces hold a ``<``, with which special tokens begin."""
    seen = np.concatenate(([0], np.cumsum(body == 60)))
    return seen[ends] > seen[starts]


def _lettered(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pieces are ASCII and Latin-1 letters only."""
    fits = _PLAIN[body] & ~((body >= 48) & (body < 58))
    lead = np.flatnonzero(body[:-1] == 0xC3)
    lead = lead[(body[lead + 1] >= 0x80) & (body[lead + 1] < 0xC0) & (body[lead + 1] != 0x97) & (body[lead + 1] != 0xB7)]
    fits[lead] = fits[lead + 1] = True
    seen = np.concatenate(([0], np.cumsum(~fits)))
    return seen[ends] == seen[starts]


class Encoder:
    """Ids of all texts of a step, as one array and the number of ids of each text.

    Chunks met before are found in a table with one place per hash; a chunk that
    finds its place taken by another is encoded anew and takes it over.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        self.tokenizer, self.end_id = tokenizer(path), end_id
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(1 << PLACE_BITS, np.uint64)
        self.begin = np.zeros(1 << PLACE_BITS, np.uint32)  # of the chunk's ids in the pool
        self.size = np.zeros(1 << PLACE_BITS, np.uint32)
        self.pool = np.zeros(POOL_IDS, np.uint32)
        self.used = 0

    def _encode(self, parts: list[bytes], lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks. One of letters only is one word to the tokenizer: its model takes it as it is."""
        model, ids = self.tokenizer.model, [None] * len(parts)
        for i in np.flatnonzero(lettered).tolist():
            word = parts[i].decode().lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids[i] = [t.id for t in model.tokenize(word)]
        others = np.flatnonzero(~lettered).tolist()
        for i, found in zip(others, self.tokenizer.encode_batch_fast([parts[i].decode("utf-8", "replace") for i in others], add_special_tokens=False)):
            ids[i] = found.ids
        sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, new: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Encode the chunks ``new``, remember them and note where their ids are."""
        values, at_first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
        view = body.tobytes()
        first = new[at_first]
        flat, sizes = self._encode([view[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], _lettered(body, starts[first], ends[first]))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(len(flat) + POOL_IDS // 8, np.uint32)))
        at = self.used + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.pool[self.used : at[-1]] = flat
        self.used = int(at[-1])
        begin[new], size[new] = at[:-1][inverse], sizes[inverse]
        place = values >> np.uint64(64 - PLACE_BITS)
        self.known[place], self.begin[place], self.size[place] = values, at[:-1], sizes

    def __call__(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > POOL_IDS:
            self._clear()
        starts, ends, first = chunks(body, at)
        h = X.word_hashes(body, starts, ends)
        odd = np.flatnonzero(_has(body, starts, ends))
        if len(odd):
            h[odd] = X.word_hashes(body, starts, ends, X.EXACT)[odd]
        place = h >> np.uint64(64 - PLACE_BITS)
        begin, size = self.begin[place], self.size[place]
        new = np.flatnonzero(self.known[place] != h)
        if len(new):
            self._learn(body, starts, ends, h, new, begin, size)
        # ids before each chunk, with one more place after each text for the end id
        end = 0 if self.end_id is None else 1
        upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        per_text = upto[first[1:]] - upto[first[:-1]] + end
        out = np.full(int(per_text.sum()), 0 if self.end_id is None else self.end_id, np.uint32)
        total = int(upto[-1])
        if total:
            count = np.arange(total)
            ids = self.pool[np.repeat(begin - upto[:-1], size) + count]
            if end:
                text = np.repeat(np.arange(len(at) - 1), np.diff(first))
                out[count + np.repeat(text, size)] = ids
            else:
                out[:] = ids
        return out, per_text


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None = END_ID) -> Encoder:
    """The worker's encoder: what it has learnt serves later tasks of the same worker."""
    return Encoder(path, end_id)
