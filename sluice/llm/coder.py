"""An adaptive context-mixing range coder for token ids, many blocks side by side.

Every block starts with fresh statistics, so each can be decoded alone. An id is
coded as its high and its low byte, each in one arithmetic-coding step under a
mixture: order 0 gives adaptive frequencies of all bytes; orders 1 and 2 each
predict one id, the one that last followed the same one or two ids in this
block, and add their weight to its byte. Weights follow how often an order's
predictions came true so far in the block. The coder is a range coder with a
32-bit range that gives out 16-bit words and carries into words given out.

All blocks of a call take a step together, as numpy arrays over blocks; a block
coded alone gets the same words.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
SLOTS = 256  # predictions a block keeps for order 1, and as many for order 2
TOTAL_BITS, BASE_BITS = 15, 12
TOTAL = 1 << TOTAL_BITS
SPIKES = TOTAL - (1 << BASE_BITS) - 2  # most that orders 1 and 2 may weigh together
#: Steps after which order 0 takes in what it has counted.
REFRESH = frozenset({8, 32, 96, 224, 480})
U = np.uint32
_WORD, _LIMIT = U(16), U(1 << 16)
_SHARE = np.array([0, *((1 << 31) // np.arange(1, BLOCK + 8))], U)  # 2**31 over a count


class Model:
    """The statistics of ``n`` blocks. Places in its tables are kept as flat positions."""

    def __init__(self, n: int):
        self.n, row = n, np.arange(n)
        self.slots, self.cells, self.base = row * SLOTS, row * 256, row * 257
        self.guess = [np.full(n * SLOTS, 0xFFFF, np.uint16) for _ in range(2)]
        self.last, self.before = np.zeros(n, U), np.zeros(n, U)
        self.uses = [np.full(n, 4, U) for _ in range(2)]
        self.hits = [np.ones(n, U) for _ in range(2)]
        self.low_hits = [np.ones(n, U) for _ in range(2)]
        self.counts = [np.ones(n * 256, np.uint16) for _ in range(2)]
        self.sums = [np.zeros(n * 257, np.uint16) for _ in range(2)]
        self.tops, self.rows = [np.zeros(0, np.uint16)] * 2, row * 16  # every sixteenth sum, close together
        self._refresh()

    def _refresh(self) -> None:
        """Order 0's frequencies, scaled to a fixed sum with at least 1 for every byte."""
        for which, (counts, sums) in enumerate(zip(self.counts, self.sums)):
            upto = np.cumsum(counts.reshape(-1, 256), axis=1, dtype=np.float32)  # whole numbers below 2**24: exact
            scaled = (upto * (np.float32((1 << BASE_BITS) - 256) / upto[:, -1:])).astype(np.uint16)
            table = sums.reshape(-1, 257)
            np.add(scaled, np.arange(1, 257, dtype=np.uint16), out=table[:, 1:])
            self.tops[which] = np.ascontiguousarray(table[:, :256:16]).ravel()

    def predict(self) -> None:
        """What orders 1 and 2 expect, and how much each weighs for the high byte."""
        one = (self.last * U(0x9E3779B1)) >> U(24)
        two = ((self.last * U(0x85EBCA6B)) ^ (self.before * U(0xC2B2AE35) + (self.before >> U(3)))) * U(0x9E3779B1) >> U(24)
        self.slot = [self.slots + one.astype(np.int64), self.slots + two.astype(np.int64)]
        expected = [g.take(s, mode="wrap").astype(U) for g, s in zip(self.guess, self.slot)]
        self.live = [e != U(0xFFFF) for e in expected]
        self.high = [e >> U(8) for e in expected]
        self.low = [e & U(255) for e in expected]
        self.spike = self._weights([self._share(self.hits[k], self.uses[k]) * self.live[k] for k in range(2)])

    @staticmethod
    def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """``part`` of ``whole``, out of ``TOTAL``."""
        return (part * _SHARE.take(whole, mode="wrap")) >> _WORD

    @staticmethod
    def _weights(trust: list[np.ndarray]) -> list[np.ndarray]:
        """Trust in order 2 comes first; order 1 gets its part of what is left."""
        two = np.minimum(trust[1], U(SPIKES))
        return [trust[0] * (U(SPIKES) - two) >> U(TOTAL_BITS), two]

    def expect_low(self, high: np.ndarray) -> None:
        """Weights for the low byte: only predictions whose high byte has come true count."""
        self.right = [self.live[k] & (self.high[k] == high) for k in range(2)]
        self.low_spike = self._weights([self._share(self.low_hits[k], self.hits[k]) * self.right[k] for k in range(2)])

    def _sum(self, which: int, place: np.ndarray) -> np.ndarray:
        return self.sums[which].take(place, mode="wrap").astype(U)

    def interval(self, which: int, byte: np.ndarray, predicted: list[np.ndarray], spike: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where a byte's interval starts in the mixture, and its width."""
        rest = U(TOTAL) - spike[0] - spike[1]
        place = self.base + byte.astype(np.int64)
        start = self._sum(which, place) * rest >> U(BASE_BITS)
        place += 1
        width = (self._sum(which, place) * rest >> U(BASE_BITS)) - start
        for k in range(2):
            start += spike[k] * (predicted[k] < byte)
            width += spike[k] * (predicted[k] == byte)
        return start, width

    def find(self, which: int, value: np.ndarray, predicted: list[np.ndarray], spike: list[np.ndarray]) -> np.ndarray:
        """The byte in whose interval ``value`` lies.

        Up to a predicted byte the mixture is order 0 alone; after it, order 0
        moved on by the weight of the prediction. So the weights of predictions
        that end before the value are taken off, and order 0 is searched.
        """
        rest = U(TOTAL) - spike[0] - spike[1]
        swap = predicted[0] > predicted[1]
        small, large = np.minimum(*predicted), np.maximum(*predicted)
        small_spike, large_spike = np.where(swap, spike[1], spike[0]), np.where(swap, spike[0], spike[1])
        after_small = self._sum(which, self.base + small.astype(np.int64) + 1) * rest >> U(BASE_BITS)
        after_large = self._sum(which, self.base + large.astype(np.int64) + 1) * rest >> U(BASE_BITS)
        # a value inside a prediction's own weight becomes the last value of that byte
        value = np.where(value >= after_small + small_spike, value - small_spike, np.minimum(value, after_small - U(1)))
        value = np.where(value >= after_large + large_spike, value - large_spike, np.where(value >= after_large, after_large - U(1), value))
        bound = ((((value + U(1)) << U(BASE_BITS)) - U(1)) // rest).astype(np.uint16)
        tops, place = self.tops[which], self.rows.copy()
        for step in (8, 4, 2, 1):
            place += (tops.take(place + step, mode="wrap") <= bound) * np.int64(step)
        sums, place = self.sums[which], self.base + (place - self.rows) * 16
        for step in (8, 4, 2, 1):
            place += (sums.take(place + step, mode="wrap") <= bound) * np.int64(step)
        return (place - self.base).astype(U)

    def update(self, ids: np.ndarray, high: np.ndarray, low: np.ndarray, step: int) -> None:
        for k in range(2):
            self.uses[k] += self.live[k]
            self.hits[k] += self.right[k]
            self.low_hits[k] += self.right[k] & (self.low[k] == low)
            self.guess[k][self.slot[k]] = ids
        for counts, byte in zip(self.counts, (high, low)):
            cell = self.cells + byte.astype(np.int64)
            counts[cell] = counts.take(cell, mode="wrap") + np.uint16(16)
        if step + 1 in REFRESH:
            self._refresh()
        self.before, self.last = self.last, ids


def split(ids: np.ndarray) -> list[np.ndarray]:
    """A sequence of ids as blocks."""
    return [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]


def encode(blocks: list[np.ndarray]) -> list[tuple[bytes, int, int]]:
    """For each block of at most ``BLOCK`` ids below 65,535: coded words, number of ids, checksum of the ids."""
    n = len(blocks)
    if not n:
        return []
    sizes = [len(b) for b in blocks]
    steps = max(sizes)
    padded = np.zeros((n, steps), U)
    for row, block in zip(padded, blocks):
        row[: len(block)] = block
    if padded.size and int(padded.max()) >= 0xFFFF:
        raise ValueError("ids must be below 65535")
    table = np.ascontiguousarray(padded.T)
    model = Model(n)
    low, width = np.zeros(n, U), np.full(n, 0xFFFFFFFF, U)
    words = np.zeros((2 * steps + 4, n), U)
    flat, used, rows = words.reshape(-1), np.zeros(n, np.int64), np.arange(n)

    def put(start: np.ndarray, span: np.ndarray) -> None:
        nonlocal low, width
        unit = width >> U(TOTAL_BITS)
        moved = low + start * unit
        carry = np.flatnonzero(moved < low)
        if len(carry):
            flat[(used[carry] - 1) * n + carry] += U(1)
        low, width = moved, span * unit
        out = np.flatnonzero(width < _LIMIT)
        if len(out):
            flat[used[out] * n + out] = low[out] >> _WORD
            used[out] += 1
            low[out] <<= _WORD
            width[out] <<= _WORD

    for step in range(steps):
        symbol = table[step]
        high, less = symbol >> U(8), symbol & U(255)
        model.predict()
        put(*model.interval(0, high, model.high, model.spike))
        model.expect_low(high)
        put(*model.interval(1, less, model.low, model.low_spike))
        model.update(symbol, high, less, step)
    for shift in (16, 0):  # what is left in the coder
        flat[used * n + rows] = (low >> U(shift)) & U(0xFFFF)
        used += 1
    for at in range(int(used.max()) - 1, 0, -1):  # carries that ran over a word
        words[at - 1] += words[at] >> _WORD
        words[at] &= U(0xFFFF)
    coded = np.ascontiguousarray(words.T.astype("<u2"))
    return [(coded[i, : used[i]].tobytes(), sizes[i], zlib.crc32(padded[i, : sizes[i]].astype("<u4").tobytes())) for i in range(n)]


def decode(blocks: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """The ids of each of the blocks made by :func:`encode`; raises where a checksum does not match."""
    n = len(blocks)
    if not n:
        return []
    longest = max(len(b) for b, _, _ in blocks) // 2
    words = np.zeros((n, longest + 4), U)
    for i, (b, _, _) in enumerate(blocks):
        words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
    words = np.ascontiguousarray(words.T)
    flat, used = words.reshape(-1), np.full(n, 2, np.int64)
    model = Model(n)
    code, width = words[0] << _WORD | words[1], np.full(n, 0xFFFFFFFF, U)
    steps = max(size for _, size, _ in blocks)
    out = np.zeros((steps, n), U)

    def take(which: int, predicted: list[np.ndarray], spike: list[np.ndarray]) -> np.ndarray:
        nonlocal code, width
        unit = width >> U(TOTAL_BITS)
        byte = model.find(which, np.minimum(code // unit, U(TOTAL - 1)), predicted, spike)
        start, span = model.interval(which, byte, predicted, spike)
        code, width = code - start * unit, span * unit
        more = np.flatnonzero(width < _LIMIT)
        if len(more):
            code[more] = code[more] << _WORD | flat[np.minimum(used[more], longest + 3) * n + more]
            used[more] += 1
            width[more] <<= _WORD
        return byte

    for step in range(steps):
        model.predict()
        high = take(0, model.high, model.spike)
        model.expect_low(high)
        low = take(1, model.low, model.low_spike)
        symbol = high << U(8) | low
        out[step] = symbol
        model.update(symbol, high, low, step)
    out = np.ascontiguousarray(out.T)
    parts = [out[i, :size] for i, (_, size, _) in enumerate(blocks)]
    for i, (part, (_, _, crc)) in enumerate(zip(parts, blocks)):
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return parts
