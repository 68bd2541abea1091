"""Elias-Fano coded monotone sequences over flat arrays that can be memory-mapped.

A value is split into low bytes, stored plainly, and a high part, stored in unary
in a bit vector.  A successor search selects the bucket of equal high parts in
the bit vector and then searches the low bytes of that bucket alone.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_FEW = 4  # values a range


_BYTES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th one of byte b, at 256 * k + b.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], np.uint64)


class EliasFano:
    """``arrays``: low (one row a byte; two or four bytes are one row of words), bits (uint64), zeros (uint32, zeros before each word); ``n`` values."""

    def __init__(self, low: np.ndarray, bits: np.ndarray, zeros: np.ndarray, n: int):
        self.low, self.bits, self.zeros, self.n = low, bits, zeros, n
        self.shift, self.mask = _U(8 * low.itemsize * len(low)), _U((1 << 8 * low.itemsize * len(low)) - 1)
        self._ones: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values``: sorted uint64 below ``universe``."""
        n = len(values)
        planes = 0
        while (universe >> (8 * planes)) > max(n, 1):
            planes += 1
        kind = {2: np.uint16, 4: np.uint32}.get(planes, np.uint8)
        low = np.empty((1 if planes in (2, 4) else planes, n), kind)
        for k in range(len(low)):
            low[k] = (values >> _U(8 * k)).astype(kind)
        high = (values >> _U(8 * planes)).astype(np.int64) if planes < 8 else np.zeros(n, np.int64)
        size = n + (universe >> (8 * planes)) + 1
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        bits = np.packbits(flags, bitorder="little").view(np.uint64)
        count = 64 - np.bitwise_count(bits).astype(np.int64)
        return cls(low, bits, (np.cumsum(count) - count).astype(np.uint32), n)

    @staticmethod
    def _select(bits: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit of ``bits``, of which ``before`` stand before each word."""
        word = np.searchsorted(before, k, "right") - 1
        x, rest = bits[word], (k - before[word]).astype(np.uint64)
        # ones up to the end of each byte, in that byte; then the byte that holds the wanted one, and its place in there
        s = x - ((x >> _U(1)) & _U(0x5555555555555555))
        s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
        s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES
        place = np.bitwise_count(((rest * _BYTES | _TOPS) - s) & _TOPS).astype(np.uint64) << _U(3)
        rest -= ((s << _U(8)) >> place) & _U(255)
        return (word << 6) + (place + _IN_BYTE[(rest << _U(8) | (x >> place) & _U(255)).astype(np.int64)]).astype(np.int64)

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero, counted from 0."""
        return self._select(_Not(self.bits), self.zeros, k)

    def select_one(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, counted from 0."""
        if self._ones is None:
            self._ones = np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64)
        return self._select(self.bits, self._ones, k)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first index, and the end, of values with each high part."""
        before = np.maximum(high - 1, 0)
        start = np.where(high > 0, self.select_zero(before) - before, 0)
        return start, self.select_zero(high) - high

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.zeros(len(index), np.uint64)
        out = self.low[0][index].astype(np.uint64)
        for k in range(1, len(self.low)):
            out |= self.low[k][index].astype(np.uint64) << _U(8 * k)
        return out

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value not below each, whether it is equal), among the values from index ``first`` to before ``end``, if given."""
        if first is not None and len(values) and (end - first).mean() <= _FEW:
            return self._among(values, first, end)
        start, stop = self.bucket((values >> self.shift).astype(np.int64) if len(self.low) < 8 else np.zeros(len(values), np.int64))
        if first is not None:
            start, stop = np.minimum(np.maximum(start, first), end), np.maximum(np.minimum(stop, end), first)
        want = values & self.mask
        lo, hi = start.copy(), stop.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._low(mid) < want[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        found = np.zeros(len(values), bool)
        inside = np.flatnonzero(lo < stop)
        found[inside] = self._low(lo[inside]) == want[inside]
        return lo, found

    def _among(self, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``successor``, for ranges so short that looking at their values costs less than finding a bucket."""
        lo, hi = first.copy(), end.copy()
        found = np.zeros(len(values), bool)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            got = self.access(mid)
            below = got < values[open_]
            found[open_] |= got == values[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return lo, found

    def access(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``."""
        if not len(index):
            return np.zeros(0, np.uint64)
        high = (self.select_one(np.asarray(index, np.int64)) - index).astype(np.uint64)
        return (high << self.shift if len(self.low) < 8 else np.uint64(0)) | self._low(index)


class _Not:
    """The complement of a bit vector, word by word."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ~self.bits[at]
