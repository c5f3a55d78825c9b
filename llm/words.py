"""Words of many texts at once: where they lie and 64-bit hashes of them, as numpy arrays.

A word is a run of bytes other than space and the controls 9 to 13, the same in UTF-8 as in
code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(7919)
_LETTER = _RNG.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_LETTER[_SEPARATOR] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, _STEP, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _STEP, np.uint64))
    return _POWERS


def chunks(texts: list[bytes], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together; a longer text is a range of its own."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of the text it is in), in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _SEPARATOR[data]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(first, dtype=np.int32) - 1
    word[: starts[0]] = 0
    at = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[word]
    np.maximum(at, 0, out=at)
    longest = int(at[~gap].max()) + 1
    np.minimum(at, longest, out=at)
    values = _LETTER[data] * powers(longest + 1)[at]
    h = mix(np.add.reduceat(values, starts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return h, np.searchsorted(ends, starts, "right")


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word (the last n - 1 have none)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p = powers(n)
    total = h[: len(h) - n + 1] * p[0]
    for k in range(1, n):
        total += h[k : len(h) - n + 1 + k] * p[k]
    return mix(total)
