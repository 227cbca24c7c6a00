"""Words of texts and 64-bit hashes of word sequences, in numpy."""
from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    """Runs without the bytes \\x20 and \\x09 to \\x0D, which no UTF-8 letter contains."""
    return text.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of ``n`` values, by doubling; at index i for the run from i on."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    power, size = mixed(hashes + np.uint64(seed * 2 + 1)), 1
    out, done = None, 0
    while True:
        if n & size:
            part = power[done:done + count]
            out = part if out is None else mixed(out * _M2 + part)
            done += size
        if done == n:
            return out
        power = mixed(power[:-size] * _M1 + power[size:])
        size *= 2


def flat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and where each text starts."""
    parts = [words_of(t) for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    flat = np.fromiter((xxh3_64_intdigest(w) for p in parts for w in p), np.uint64, int(starts[-1]))
    return flat, starts


def inside(starts: np.ndarray, n: int) -> np.ndarray:
    """For every run of ``n`` words of ``flat_words``: whether it lies inside one text."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    count = max(0, len(doc) - n + 1)
    return doc[:count] == doc[n - 1:n - 1 + count]


def covered(flags: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a run of ``n`` words that starts at a flag."""
    at = np.flatnonzero(flags)
    edge = np.bincount(at, minlength=total + 1) - np.bincount(at + n, minlength=total + 1)
    return np.cumsum(edge[:total]) > 0
