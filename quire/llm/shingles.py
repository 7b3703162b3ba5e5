"""Hashed word shingles of whole texts, computed over bytes with NumPy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32  # A-Z count as a-z
_BYTE = _BYTE[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([1], np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of the step modulo 2**64, at least n of them."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.r_[np.uint64(1), np.cumprod(np.full(2 * n, _STEP, np.uint64), dtype=np.uint64)]
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each value over all 64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: runs of bytes other than blank and 09 to 0D, letters A-Z in lower case."""
    data = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[data]
    places = np.flatnonzero(inside)
    if len(places) == 0:
        return np.empty(0, np.uint64)
    begins = np.flatnonzero(np.r_[True, np.diff(places) > 1])
    lengths = np.diff(np.r_[begins, len(places)])
    within = np.arange(len(places)) - np.repeat(begins, lengths)
    sums = np.add.reduceat(_BYTE[data[places]] * _powers(int(lengths.max()))[within], begins)
    return _mixed(sums + lengths.astype(np.uint64))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes, below 2**63, of all runs of ``width`` words.

    Fewer words make one shingle of the whole sequence; a text without words has none.
    """
    words = word_hashes(text)
    if len(words) == 0:
        return np.empty(0, np.int64)
    n = min(width, len(words))
    runs = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        runs = runs * _STEP + words[i : len(words) - n + 1 + i]
    return np.unique(_mixed(runs) >> np.uint64(1)).astype(np.int64)
