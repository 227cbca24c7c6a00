"""Counts and word spans of texts in one table-driven pass over their bytes, in numpy."""
from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from textloom.llm.hashing import mixed

SYMBOLS = b"#$%&*|"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

# Classes of bytes: a lead byte, a blank, a capital, a symbol, or a further byte of a code point.
LEAD, BLANK, CAPITAL, SYMBOL, TAIL = range(5)
# States: between words, inside a word.
OUTSIDE, INSIDE = range(2)
# What a step puts out.
POINT, IS_CAPITAL, IS_SYMBOL, WORD = 1, 2, 4, 8

CLASS = np.full(256, LEAD, np.uint8)
CLASS[0x80:0xC0] = TAIL
CLASS[list(BLANKS)] = BLANK
CLASS[ord("A"):ord("Z") + 1] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL

# NEXT[class]: every class leads to one state from both, so the state before a byte is that of
# the byte before it, and the whole pass is two table lookups.
NEXT = np.array([INSIDE, OUTSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
# OUT[state, class]
OUT = np.array([
    [POINT | WORD, POINT, POINT | IS_CAPITAL | WORD, POINT | IS_SYMBOL | WORD, WORD],
    [POINT, POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, 0],
], np.uint8)

# Longer words are hashed and compared one by one.
LONG_WORD = 128
_M = np.uint64(0x9E3779B97F4A7C15)
# KEEP[k]: the first k bytes of a little-endian lane of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[starts])


class Spans:
    """Spans of bytes with a group each, kept in an open hash table that compares whole spans."""

    def __init__(self, data: bytes, begins: np.ndarray, ends: np.ndarray, group: np.ndarray):
        self._data, self._begins, self._sizes, self._group = data, begins, ends - begins, group
        padded = data + b"\0" * 8
        # Eight bytes from every offset on.
        self._lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))

    def _lane(self, at: np.ndarray, k: int) -> np.ndarray:
        """The bytes 8k to 8k+7 of these spans, zero beyond their end."""
        left = np.minimum(self._sizes[at] - 8 * k, 8)
        return self._lanes[self._begins[at] + 8 * k] & _KEEP[left]

    def _bytes(self, i: int) -> bytes:
        return self._data[self._begins[i]:self._begins[i] + self._sizes[i]]

    def hashes(self) -> np.ndarray:
        value = mixed(self._group.astype(np.uint64) * _M + self._sizes.astype(np.uint64))
        at, k = np.flatnonzero(self._sizes <= LONG_WORD), 0
        while len(at):
            value[at] = mixed(value[at] * _M + self._lane(at, k))
            k += 1
            at = at[self._sizes[at] > 8 * k]
        for i in np.flatnonzero(self._sizes > LONG_WORD).tolist():
            value[i] ^= np.uint64(xxh3_64_intdigest(self._bytes(i)))
        return value

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans ``a`` and ``b`` have one group and the same bytes."""
        same = (self._sizes[a] == self._sizes[b]) & (self._group[a] == self._group[b])
        at, k = np.flatnonzero(same & (self._sizes[a] <= LONG_WORD)), 0
        while len(at):
            right = self._lane(a[at], k) == self._lane(b[at], k)
            same[at[~right]] = False
            k += 1
            at = at[right]
            at = at[self._sizes[a[at]] > 8 * k]
        for i in np.flatnonzero(same & (self._sizes[a] > LONG_WORD)).tolist():
            same[i] = self._bytes(a[i]) == self._bytes(b[i])
        return same

    def first_occurrences(self, hashes: np.ndarray | None = None) -> np.ndarray:
        """Which spans are the first of their kind.

        All spans enter a table of at least twice their number at once: the first one at a
        free slot takes it, one equal to the slot's owner is a repetition, any other one goes
        on to the next slot. Equal hashes alone decide nothing.
        """
        n = len(self._begins)
        first = np.zeros(n, bool)
        hashes = self.hashes() if hashes is None else hashes
        mask = (1 << max(1, (2 * n - 1).bit_length())) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        table = np.full(mask + 1, -1, np.int64)
        waiting = np.arange(n)
        while len(waiting):
            free = waiting[table[slot[waiting]] < 0]
            table[slot[free[::-1]]] = free[::-1]  # of several spans the first is written last
            owner = table[slot[waiting]]
            own = owner == waiting
            first[waiting[own]] = True
            rest, owner = waiting[~own], owner[~own]
            likely = hashes[rest] == hashes[owner]
            found = np.zeros(len(rest), bool)
            found[likely] = self.equal(rest[likely], owner[likely])
            waiting = rest[~found]
            slot[waiting] = (slot[waiting] + 1) & mask
        return first


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_points and n_symbols of every text."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    joined = b"".join(texts)
    kinds = CLASS[np.frombuffer(joined, np.uint8)]
    after = NEXT[kinds]
    before = np.concatenate([[OUTSIDE], after[:-1]]).astype(np.uint8)[:len(kinds)]
    fresh = starts[:-1][np.diff(starts) > 0]
    before[fresh] = OUTSIDE
    out = OUT[before, kinds]
    begins = np.flatnonzero(out & WORD)
    # A word ends where the next byte is outside, or begins another text.
    follows = np.append(after[1:], OUTSIDE)[:len(kinds)]
    follows[fresh[1:] - 1] = OUTSIDE
    ends = np.flatnonzero((after == INSIDE) & (follows == OUTSIDE)) + 1
    words = per_text((out & WORD) > 0, starts)
    first = Spans(joined, begins, ends, np.repeat(np.arange(len(texts)), words)).first_occurrences()
    return {
        "n_words": words, "n_distinct": per_text(first, np.concatenate([[0], np.cumsum(words)])),
        "n_capitals": per_text((out & IS_CAPITAL) > 0, starts), "n_points": per_text((out & POINT) > 0, starts),
        "n_symbols": per_text((out & IS_SYMBOL) > 0, starts),
    }
