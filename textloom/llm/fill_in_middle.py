"""Fill-in-the-middle examples; cuts are found by a piecewise-linear index of code point boundaries."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import text_blocks

# Largest distance between a boundary and its segment's line; leaves room for rounding in an int8.
ERROR_BOUND = 100
# Boundaries looked at in one numpy step while a segment grows.
STEP = 1 << 16
# Bytes of text with one index; every boundary of them takes 8 bytes while the index is fitted.
BLOCK = 2 << 20


@dataclass(frozen=True)
class FimRule:
    """How texts are turned: percent of texts that are cut, percent of these with the suffix first."""

    cut_percent: int = 90
    spm_percent: int = 20
    seed: int = 1
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class RankIndex:
    """The offset of every boundary from its rank: a line per segment, and a residual per boundary.

    A segment grows while one slope keeps all of its boundaries within the error bound of
    the line through its first one. Offsets are the prediction plus the stored residual, so
    they are exact whatever the lines are.
    """

    def __init__(self, offsets: np.ndarray, bound: int = ERROR_BOUND):
        n = len(offsets)
        self.residuals = np.zeros(n, np.int8)
        firsts, bases, slopes = [], [], []
        start = 0
        while start < n:
            stop, slope = _segment(offsets, start, bound)
            firsts.append(start)
            bases.append(offsets[start])
            slopes.append(slope)
            for at in range(start, stop, STEP):
                ranks = np.arange(at, min(at + STEP, stop))
                line = offsets[start] + np.floor(slope * (ranks - start)).astype(np.int64)
                self.residuals[ranks] = offsets[ranks] - line
            start = stop
        self.firsts, self.bases = np.array(firsts, np.int64), np.array(bases, np.int64)
        self.slopes = np.array(slopes, np.float64)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets of the boundaries with these ranks."""
        segment = np.searchsorted(self.firsts, ranks, "right") - 1
        line = np.floor(self.slopes[segment] * (ranks - self.firsts[segment])).astype(np.int64)
        return self.bases[segment] + line + self.residuals[ranks]


def _segment(offsets: np.ndarray, start: int, bound: int) -> tuple[int, float]:
    """(end of the longest segment from ``start`` on, its slope)."""
    low, high, done, size = -np.inf, np.inf, start + 1, 256
    while done < len(offsets):
        stop = min(len(offsets), done + size)
        run = np.arange(done - start, stop - start)
        rise = offsets[done:stop] - offsets[start]
        lows = np.maximum.accumulate(np.maximum((rise - bound) / run, low))
        highs = np.minimum.accumulate(np.minimum((rise + bound) / run, high))
        wrong = lows > highs
        fit = int(wrong.argmax()) if wrong.any() else len(run)
        if fit:
            low, high = lows[fit - 1], highs[fit - 1]
        done += fit
        if fit < len(run):
            break
        size = min(2 * size, STEP)
    return done, (low + high) / 2 if done > start + 1 else 0.0


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets at which a code point begins, or a text does, and the end of the data."""
    leads = (data & 0xC0) != 0x80
    leads[starts[:-1][np.diff(starts) > 0]] = True
    return np.append(np.flatnonzero(leads), len(data))


def draws(seed: int, ids: list) -> np.ndarray:
    """Four 32-bit numbers per id, from the SHA-256 of seed, colon and decimal id."""
    keys = (f"{seed}:{'' if i is None else i}".encode() for i in ids)
    return np.frombuffer(b"".join(hashlib.sha256(k).digest()[:16] for k in keys), ">u4").reshape(-1, 4).astype(np.int64)


def transform(ids: list, texts: list[bytes], rule: FimRule) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """(n, form, prefix_chars, middle_chars, output) of every text."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    offsets = boundaries(np.frombuffer(b"".join(texts), np.uint8), starts)
    first = np.searchsorted(offsets, starts)  # rank of each text's begin
    index = RankIndex(offsets)
    n = np.diff(first)
    h = draws(rule.seed, ids)
    ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cuts = index[first[:-1, None] + ends] - starts[:-1, None]
    marks = [m.encode() for m in (rule.prefix, rule.suffix, rule.middle)]
    p, s, m = marks
    out = []
    for text, size, draw, end, cut in zip(texts, n.tolist(), h.tolist(), ends.tolist(), cuts.tolist()):
        if not text or draw[2] % 100 >= rule.cut_percent or any(mark in text for mark in marks):
            out.append((size, "plain", None, None, text))
            continue
        before, between, after = text[:cut[0]], text[cut[0]:cut[1]], text[cut[1]:]
        spm = draw[3] % 100 < rule.spm_percent
        joined = b"".join([s, after, p, before, m, between] if spm else [p, before, s, after, m, between])
        out.append((size, "spm" if spm else "psm", end[0], end[1] - end[0], joined))
    return out


def fill_in_middle(
    docs: DataFrame, rule: FimRule = FimRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    Whole texts are cut at two code point boundaries drawn from the id. A block of texts has
    one ``RankIndex`` over all of its boundaries; both cuts of a text are predicted and
    corrected from it. Rows stay in their partition, nothing is shuffled.

    A null text is empty, and an empty text is ``plain``, as is one that holds a mark, for
    ``restored`` must find the marks again. Lengths are null where nothing was cut. A null
    id draws like an empty one; rows that repeat an id draw the same numbers, and equal rows
    give equal results; an empty table gives no rows; other columns are not read.
    """
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = transform(batch.column("id").to_pylist(), batch.column("text").to_pylist(), rule)
        n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
             pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    made = text_blocks(docs, block, schema, id_col, text_col, block_bytes=BLOCK)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, rule: FimRule = FimRule()) -> Column:
    """The text from an output and its form; null from null.

    No mark lies inside a cut text or across its edges, so the marks split the output into
    an empty piece and the three parts.
    """
    marks = "|".join(f"\\Q{m}\\E" for m in (rule.prefix, rule.suffix, rule.middle))
    parts = F.split(output, marks, -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
