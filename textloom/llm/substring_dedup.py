"""Repeated word sequences across documents: seeds from winnowing, extended to whole repeats."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import in_blocks, stored, text_blocks
from textloom.llm.hashing import covered, flat_words, inside, mixed, window_hashes, words_of
from textloom.llm.heavy import with_group

# Words of a seed. Among the seeds inside each run of ``min_words`` words the least one is an anchor.
SEED = 8
_BASE = np.uint64(0x9DDFEA08EB382D69)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _anchors(flat: np.ndarray, starts: np.ndarray, min_words: int, seed: int) -> tuple[np.ndarray, ...]:
    """(seed hashes; per run of ``min_words`` words: inside one text, position of its anchor).

    Equal runs have their anchor at the same place: the leftmost of the least hashes.
    """
    grams = mixed(window_hashes(flat, seed, 1))
    valid = inside(starts, min_words)
    width = min_words - seed + 1
    value, place, size = grams, np.arange(len(grams)), 1
    if len(valid) == 0:
        return grams, valid, np.empty(0, np.int64)

    def least(step: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        first = value[:count] <= value[step:step + count]
        return (np.where(first, value[:count], value[step:step + count]),
                np.where(first, place[:count], place[step:step + count]))

    while 2 * size <= width:
        value, place = least(size, len(value) - size)
        size *= 2
    if size < width:
        value, place = least(width - size, len(value) - (width - size))
    return grams, valid, place[:len(valid)]


def _spans(flat: np.ndarray, doc: np.ndarray, at: np.ndarray, min_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor: hash and end of the words up to the end of the first anchor that makes them
    ``min_words`` or more; end 0 where the text has no such anchor."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(flat), _BASE)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat) * power[:-1])])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(flat), _INVERSE)]))
        last = np.searchsorted(at, at + (min_words - seed))
        ok = (last < len(at)) & (doc[at[np.minimum(last, len(at) - 1)]] == doc[at])
        end = np.where(ok, at[np.minimum(last, len(at) - 1)] + seed, 0)
        value = mixed((sums[end] - sums[at]) * back[at] + mixed((end - at).astype(np.uint64)))
    return np.where(ok, value, 0).astype(np.uint64), end


def joined_words(words: list[bytes]) -> bytes:
    """The kept words of a text as one text."""
    return b" ".join(words)


def _seen_again(seeds: list[dict], size: int, anchor: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For a text of ``size`` words and the anchor of each run: (covered words, runs to ask for)."""
    again, known = np.zeros(size + 1, np.int64), np.zeros(size + 1, bool)
    for x in seeds:
        again[x["pos"]] = x["n_anchor"]
    runs = again[anchor]
    ask = runs > 1
    for x in seeds:
        if x["n_span"] > 1:
            first, last = x["pos"], x["pos"] + x["length"]
            known[first:last] = True
            inner = slice(first, last - min_words + 1)
            ask[inner] &= runs[inner] != x["n_span"]
    return known[:size], ask


def remove_repeats(
    docs: DataFrame, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text",
    finish: Callable[[list[bytes]], bytes] = joined_words, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans, kept.

    Every word goes that is covered by a sequence of ``min_words`` words which starts
    anywhere else as well, in the same or another document. ``spans`` holds the maximal
    covered runs as pairs of word positions (start, end); ``kept`` is ``finish`` of the
    other words, by default their text.

    1. Winnowing picks anchors: every run of ``min_words`` words holds one seed of ``seed`` words, at
       the same place wherever it occurs. Anchors are counted over all documents.
    2. A seed that occurs again is extended to the anchors after it. The words of such a
       stretch are hashed and counted: one that occurs again covers all its words.
    3. Both ways beyond the stretches, every run with a repeated anchor is hashed and
       counted by itself. A run inside a repeated stretch is left out only where all
       occurrences of its anchor lie in such stretches, as nobody else can then ask for it.

    No pair of documents is ever made: equal hashes are counted in groups, and the
    frequent ones split off (``heavy.with_group``). Texts are shuffled once, those with
    runs to ask for a second time.

    Null and empty texts have no words. Every row is a document: rows that repeat id and
    text are copies of each other. Null ids are kept. An empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("h", F.hash("text"))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = flat_words(batch.column("text").to_pylist())
        grams, valid, place = _anchors(flat, starts, min_words, seed)
        at = np.unique(place[valid])
        doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        span, end = _spans(flat, doc, at, min_words, seed)
        row = doc[at]
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(row)), batch.column("h").take(pa.array(row)),
             pa.array((at - starts[row]).astype(np.int32)), pa.array(grams[at].view(np.int64)),
             pa.array(span.view(np.int64)), pa.array(np.where(end > 0, end - at, 0).astype(np.int32))],
            ["id", "h", "pos", "anchor", "span", "length"])

    anchors = stored(text_blocks(
        given, find, f"id {kind}, h int, pos int, anchor bigint, span bigint, length int", "id", "text", extra=("h",)), "anchors")
    seeds = stored(with_group(anchors, "anchor", {}, smallest=2).withColumnRenamed("n", "n_anchor"), "seeds")
    columns = ["id", "h", "pos", "length", "n_anchor"]
    stretched = with_group(seeds.where("length > 0"), "span", {}).select(*columns, F.col("n").alias("n_span")).unionByName(
        seeds.where("length = 0").select(*columns, F.lit(0).cast("bigint").alias("n_span")))
    info = stretched.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(
        F.collect_list(F.struct("pos", "length", "n_anchor", "n_span")).alias("seeds"))
    joined = given.join(info, given["id"].eqNullSafe(info["_id"]) & (given["h"] == info["_h"]), "left").select(
        "id", "h", F.col("text").cast("binary").alias("text"), "seeds")

    def result(words: list[bytes], gone: np.ndarray) -> tuple[int, list[int], bytes]:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        kept = [words[i] for i in np.flatnonzero(~gone)] if len(edges) else words
        return int(gone.sum()), edges.tolist(), finish(kept)

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, seen = batch.column("text").to_pylist(), batch.column("seeds").to_pylist()
        flat, starts = flat_words(texts)
        _, valid, place = _anchors(flat, starts, min_words, seed)
        hashes = window_hashes(flat, min_words)
        out = []
        for i, (text, seeds_here) in enumerate(zip(texts, seen)):
            words, first, last = words_of(text), int(starts[i]), int(starts[i + 1])
            gone, ask = np.zeros(len(words), bool), np.empty(0, np.int64)
            if seeds_here:
                runs = slice(first, last - min_words + 1)
                gone, asked = _seen_again(seeds_here, len(words), place[runs] - first, min_words)
                ask = np.flatnonzero(asked & valid[runs])
            if len(ask):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                out.append((len(words), text, edges.tolist(), ask.tolist(), hashes[first + ask].view(np.int64).tolist(), 0, None))
            else:
                n, spans, kept = result(words, gone)
                out.append((len(words), None, spans, [], [], n, kept))
        n_words, text, spans, ask, hashed, removed, kept = zip(*out)
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("h"), pa.array(n_words, pa.int64()), pa.array(text, pa.binary()),
             pa.array(spans, ints), pa.array(ask, ints), pa.array(hashed, pa.list_(pa.int64())),
             pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            ["id", "h", "n_words", "text", "spans", "ask", "hashes", "n_removed", "kept"])

    extended = stored(joined.mapInArrow(in_blocks(extend), f"id {kind}, h int, n_words bigint, text binary, spans array<int>, "
                                        "ask array<int>, hashes array<bigint>, n_removed bigint, kept binary"), "extended")
    asked = extended.select("id", "h", F.inline(F.arrays_zip(F.col("ask"), F.col("hashes")))).withColumnRenamed("hashes", "run")
    again = with_group(asked, "run", {}, smallest=2).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(
        F.collect_set("ask").alias("runs"))
    open_rows = extended.where("text is not null").select("id", "h", "n_words", "text", "spans")
    decided = open_rows.join(
        again, open_rows["id"].eqNullSafe(again["_id"]) & (open_rows["h"] == again["_h"]), "left"
    ).select("id", "n_words", "text", "spans", "runs")

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans, runs in zip(*[batch.column(c).to_pylist() for c in ("text", "spans", "runs")]):
            words = words_of(text)
            gone = np.zeros(len(words), bool)
            for first, last in zip(spans[::2], spans[1::2]):
                gone[first:last] = True
            if runs:
                flags = np.zeros(len(words), bool)
                flags[runs] = True
                gone |= covered(flags, min_words, len(words))
            out.append(result(words, gone))
        removed, spans, kept = zip(*out)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_words"), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())],
            ["doc_id", "n_words", "n_removed", "spans", "kept"])

    closed = decided.mapInArrow(in_blocks(close), f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<int>, kept binary")
    return extended.where("text is null").select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "spans", "kept").unionByName(closed)
