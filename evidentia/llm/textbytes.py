"""NumPy kernels over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multiplier of the rolling hash modulo 2**64, its inverse, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept."""
    if n > 1 << 22 or len(_powers.get(base, ())) < max(1, n):
        size = n if n > 1 << 22 else 1 << max(12, (n - 1).bit_length())
        out = np.full(size, np.uint64(base))
        out[0] = 1
        out = np.cumprod(out, dtype=np.uint64)
        if n > 1 << 22:
            return out
        _powers[base] = out
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of any spans of data in constant time each, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        inverse = powers(BASE_INVERSE, len(self.sums))
        length = (stop - start).astype(np.uint64)
        return mixed((self.sums[stop] - self.sums[start]) * inverse[start] + length * np.uint64(0xA0761D6478BD642F))


def spans(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of inside, cut at the texts' ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values in each [ends[i], ends[i + 1]); empty ranges have 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def owner(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(ends, at, "right") - 1
