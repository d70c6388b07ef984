"""Rolling hashes and sliding minima over numpy arrays."""

from __future__ import annotations

import numpy as np

#: An odd base, its inverse modulo 2**64, and a mixing multiplier.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n or more."""
    if _powers["n"] < n:
        n = max(n, 1 << 14)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


class Prefix:
    """Hashes of any range of an array of numbers, from sums of value * BASE**position modulo 2**64."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x = x ^ (x >> np.uint64(32))
    return x * MIX


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, from minima of blocks read forwards and backwards."""
    n = len(x)
    if n < w:
        return x[:0]
    if w == 1:
        return x.copy()
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For every window of w grams, the position of the smallest hash, the rightmost of equal ones."""
    place = np.arange(len(grams), dtype=np.uint64)
    turned = np.uint64(0xFFFFFFFF) - place
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | turned
    return (np.uint64(0xFFFFFFFF) - (sliding_min(key, w) & np.uint64(0xFFFFFFFF))).astype(np.int64)
