"""MinHash signatures and banding."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1
MASK = (1 << 32) - 1
WORDS_PER_BLOCK = 1 << 14
# Words whose strings and hashes a worker holds at once (one row may hold more).
WORDS_PER_SLICE = 1 << 18


def coefficients(num_perm: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the permutation family, fixed by the seed."""
    gen = np.random.RandomState(seed)
    pairs = [
        (gen.randint(1, PRIME, dtype=np.uint64), gen.randint(0, PRIME, dtype=np.uint64))
        for _ in range(num_perm)
    ]
    a, b = zip(*pairs)
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def word_hash(word: str) -> int:
    """First four bytes of SHA-1, least significant byte first."""
    return int.from_bytes(hashlib.sha1(word.encode()).digest()[:4], "little")


def signatures(word_lists: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, num_perm) minima of ((a·h + b) mod 2^64 mod PRIME) & MASK per row.

    Each distinct word of the batch is hashed once; words are permuted in blocks, so
    memory stays flat however long one text is. Empty lists keep the maximum value.
    """
    codes = pa.compute.dictionary_encode(word_lists.flatten())
    hashes = np.fromiter(
        (word_hash(w) for w in codes.dictionary.to_pylist()),
        dtype=np.uint64, count=len(codes.dictionary),
    )
    flat = hashes[codes.indices.to_numpy(zero_copy_only=False)] if len(codes) else hashes
    lengths = pa.compute.list_value_length(word_lists).fill_null(0).to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(word_lists)), lengths)
    out = np.full((len(word_lists), len(a)), MASK, dtype=np.uint64)
    for start in range(0, len(flat), WORDS_PER_BLOCK):
        rows = row_of[start:start + WORDS_PER_BLOCK]
        h = flat[start:start + WORDS_PER_BLOCK, None]
        permuted = ((h * a + b) % np.uint64(PRIME)) & np.uint64(MASK)
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        minima = np.minimum.reduceat(permuted, first, axis=0)
        out[rows[first]] = np.minimum(out[rows[first]], minima)
    return out


def _slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Parts of a batch that reach ``WORDS_PER_SLICE`` words at their last row at the latest."""
    words = np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(lists):
        end = min(len(lists), int(np.searchsorted(words, (words[start - 1] if start else 0) + WORDS_PER_SLICE)) + 1)
        yield lists.slice(start, end - start)
        start = end


def minhash_signature(shingles: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """Signature as ARRAY<BIGINT> of length ``num_perm``; null for no shingles."""

    @F.arrow_udf("array<bigint>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b = coefficients(num_perm, seed)
        for batch in batches:
            lists = batch.cast(pa.list_(pa.string()))
            minima = np.concatenate(
                [signatures(part, a, b).astype(np.int64) for part in _slices(lists)] or [np.empty((0, num_perm), np.int64)])
            empty = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False) == 0
            offsets = pa.array(
                np.arange(0, minima.size + 1, minima.shape[1]), pa.int32(),
                mask=np.r_[empty, False] if empty.any() else None,
            )
            yield pa.ListArray.from_arrays(offsets, pa.array(minima.ravel()))

    return sign(shingles)


def band_layout(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows) with the least equal-weight error around ``threshold``.

    A pair of similarity s shares a band with probability 1-(1-s^r)^b. The error is
    the area of that curve below the threshold plus the area missing above it.
    """
    s = (np.arange(2000) + 0.5) / 2000
    below = s < threshold
    best = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            hit = 1.0 - (1.0 - s**rows) ** bands
            error = hit[below].sum() + (1.0 - hit[~below]).sum()
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]


def lsh_bands(signature: Column, bands: int, rows: int) -> Column:
    """One 16-byte key per band; the band number is part of the key."""
    return F.array(*[
        F.unhex(F.md5(F.concat_ws(
            ",", F.lit(str(i)), F.slice(signature, i * rows + 1, rows).cast("array<string>")
        )))
        for i in range(bands)
    ])
