"""Hashes of words and of runs of words, from their bytes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that order of hashes says nothing about words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES]
_LONG = 256


def word_hashes(words: pa.Array, families: int = 2) -> np.ndarray:
    """Up to two independent 64-bit hashes of each word, from its bytes; words over ``_LONG`` bytes are hashed one by one."""
    flat = words.cast(pa.large_binary())
    bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    if not len(flat):
        return np.zeros((families, 1), np.uint64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    start, stop = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    out = np.empty((families, len(flat)), np.uint64)
    for k, base in enumerate(_BASES[:families]):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[k][data] * _powers(base, len(data)), dtype=np.uint64)])
        value = (sums[stop] - sums[start]) * _powers(pow(base, -1, 1 << 64), len(data) + 1)[start]
        out[k] = mix(value ^ (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    for i in np.flatnonzero(stop - start > _LONG):
        out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(flat[int(i)].as_py()), np.uint64)[:families]
    return out


class Rolling:
    """Hashes of any run of words, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, codes: np.ndarray, table: np.ndarray, family: int):
        base, n = _BASES[family], len(codes)
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[family][codes] * _powers(base, n), dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of words start..stop, the length mixed in."""
        value = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mix(value ^ (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
