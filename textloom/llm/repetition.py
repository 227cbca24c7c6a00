"""Quality rules on repetition: characters inside repeated word runs and repeated lines."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.blocks import text_blocks
from textloom.llm.hashing import covered, inside, mixed, window_hashes, words_of
from xxhash import xxh3_64_intdigest

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
BASE_RUN = 5


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares of characters inside repeated runs of so many words, and in repeated lines."""

    run_shares: dict[int, float] = field(default_factory=lambda: {
        5: .15, 6: .14, 7: .13, 8: .12, 9: .11, 10: .10})
    line_chars_share: float = .20
    lines_share: float = .30
    min_words: int = 10
    repeat_words_percent: int = 20


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "run_chars array<double>, dup_line_chars double, dup_lines double, base_failed boolean, kept boolean"
)


def _repeated(hashes: np.ndarray, doc: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which runs occur at least twice in their own text."""
    out = np.zeros(len(hashes), bool)
    at = np.flatnonzero(valid)
    if len(at) == 0:
        return out
    key = mixed(hashes[at] ^ mixed(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out[at[order[twice]]] = True
    return out


def _code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def measure(texts: list[bytes], runs: Sequence[int]) -> dict[str, np.ndarray]:
    """Counts and shares of each text; the shares are over the characters of its words."""
    n = len(texts)
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(n_words, out=starts[1:])
    total = int(starts[-1])
    flat = np.fromiter((xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, total)
    doc = np.repeat(np.arange(n), n_words)
    # Code points of a word: its bytes but for UTF-8 continuation bytes.
    joined = np.frombuffer(b"".join(w for ws in words for w in ws), np.uint8)
    ends = np.zeros(total + 1, np.int64)
    np.cumsum(np.fromiter((len(w) for ws in words for w in ws), np.int64, total), out=ends[1:])
    points = np.zeros(len(joined) + 1, np.int64)
    np.cumsum((joined & 0xC0) != 0x80, out=points[1:])
    chars = np.diff(points[ends])

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(total + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return np.diff(sums[starts])

    word_chars = per_text(chars)
    shares, repeat_words = [], np.zeros(n, np.int64)
    for size in sorted({BASE_RUN, *runs}):
        hit = covered(_repeated(window_hashes(flat, size), doc, inside(starts, size)), size, total)
        if size == BASE_RUN:
            repeat_words = per_text(hit)
        if size in runs:
            shares.append(per_text(hit * chars) / np.maximum(word_chars, 1))
    dup_lines, lines_share, line_chars = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for i, text in enumerate(texts):
        seen, lines, dup, all_chars, dup_chars = set(), 0, 0, 0, 0
        for line in text.split(b"\n"):
            if not line.strip():
                continue
            lines += 1
            size = _code_points(line)
            all_chars += size
            if line in seen:
                dup += 1
                dup_chars += size
            else:
                seen.add(line)
        dup_lines[i], lines_share[i], line_chars[i] = dup, dup / max(lines, 1), dup_chars / max(all_chars, 1)
    return {
        "n_words": n_words, "word_chars": word_chars,
        "n_symbols": np.array([int(_SYMBOL[np.frombuffer(t, np.uint8)].sum()) for t in texts], np.int64),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "run_chars": np.stack(shares, axis=1) if shares else np.zeros((n, 0)),
        "dup_line_chars": line_chars, "dup_lines": lines_share,
    }


def repetition_rules(
    docs: DataFrame, rules: RepetitionRules | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: measures of repetition and the verdict ``kept``.

    Words are runs without ASCII white space. ``run_chars`` holds, for each length of
    ``rules.run_shares`` in ascending order, the share of word characters inside word runs
    of that length that occur twice or more in the text (first occurrences included).
    ``base_failed`` means too few words or too many words in repeated runs of five;
    ``kept`` needs that and every share within its limit. Rows never leave their partition.

    Null and empty texts have no words: all counts are 0, ``base_failed`` is true, ``kept``
    false. A null id stays null; repeated rows give repeated results; an empty table gives
    no rows; other columns are not read.
    """
    rules = rules or RepetitionRules()
    runs = sorted(rules.run_shares)
    limits = np.array([rules.run_shares[r] for r in runs])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column("text").to_pylist(), runs)
        failed = (m["n_words"] < rules.min_words) | (
            100 * m["n_repeat_words"] > rules.repeat_words_percent * m["n_words"])
        kept = ~failed & (m["run_chars"] <= limits).all(axis=1) & (
            m["dup_line_chars"] <= rules.line_chars_share) & (m["dup_lines"] <= rules.lines_share)
        shares = pa.array(list(m.pop("run_chars")), pa.list_(pa.float64()))
        cols = {k: pa.array(v) for k, v in m.items()}
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), *[cols[k] for k in names], shares, cols["dup_line_chars"], cols["dup_lines"],
             pa.array(failed), pa.array(kept)],
            ["doc_id", *names, "run_chars", "dup_line_chars", "dup_lines", "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_blocks(docs, block, SCHEMA.replace("doc_id bigint", f"doc_id {kind}"), id_col, text_col)
