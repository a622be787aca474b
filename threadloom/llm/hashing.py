"""64-bit hashes of many byte ranges at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STRETCH = 1 << 20  # bytes that are summed at a time, unless one range is longer


def hashes_between(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range [start, end) of the bytes, from running sums of a random value a byte times a power of its place.

    The ranges are in order and don't overlap. A hash doesn't depend on where its range
    lies, so long texts are hashed a stretch of whole ranges at a time.
    """
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + STRETCH, side="right")))
        first, last = int(start[at]), int(end[stop - 1])
        out[at:stop] = _hashed(raw[first:last], start[at:stop] - first, end[at:stop] - first)
        at = stop
    return out


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if len(_powers["up"]) <= len(raw):
        n = max(2 * len(raw), 1 << 16)
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, base in (("up", BASE), ("down", back)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers["up"][: len(raw)])])
    return mix((total[end] - total[start]) * _powers["down"][start] + (end - start).astype(np.uint64))
