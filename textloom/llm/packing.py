"""Packing token lists into sequences under several limits at once."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import split, stored
from textloom.llm.subwords import SubwordEncoder, encoder

# Partitions whose last, unfinished sequences are repacked together.
REPACKED = 512
# Texts that are encoded and packed at a time: positions of chunks, ids and pieces take several times the texts.
SLICE = 4 << 20


@dataclass(frozen=True)
class PackLimits:
    """What one sequence may hold: tokens, pieces of documents, and tokens that bear loss."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


class Packer:
    """Fills one sequence after the other with the piece whose needs fit its free room best.

    The needs (tokens, one segment, loss-bearing tokens) and the free room are shares of the
    limits; the piece with the largest dot product of the two is placed next. When no whole
    piece fits and cutting is allowed, the longest one is cut to fill the sequence. Loss is
    borne by the last ``loss`` tokens of an example, as an answer follows its prompt.
    """

    def __init__(self, limits: PackLimits, cut: bool):
        self.limits, self.cut = limits, cut
        self.sequence, self.open = 0, []
        self._clear()

    def _clear(self) -> None:
        m = self.limits
        self.room = np.array([m.tokens, m.segments, m.loss], np.int64)

    def close(self) -> list[tuple]:
        done, self.open = self.open, []
        self.sequence += bool(done)
        self._clear()
        return done

    def pack(self, tokens: np.ndarray, loss: np.ndarray) -> Iterator[tuple]:
        """(example, start, length, sequence, offset) of every finished sequence."""
        m = self.limits
        full = np.array([m.tokens, m.segments, m.loss], float)
        tokens, prompt = tokens.astype(np.int64), (tokens - loss).astype(np.int64)
        start = np.zeros(len(tokens), np.int64)
        order = np.argsort(-tokens, kind="stable")
        left = [int(i) for i in order if tokens[i] > 0]
        at = np.array(left, np.int64)
        need_t, need_l = tokens[at].copy(), loss[at].astype(np.int64).copy()
        while len(at):
            fits = (need_t <= self.room[0]) & (need_l <= self.room[2])
            take = None
            if self.room[1] > 0 and fits.any():
                w = self.room / full
                score = need_t * (w[0] / full[0]) + need_l * (w[2] / full[2]) + w[1] / full[1]
                k = int(np.argmax(np.where(fits, score, -1.0)))
                take = need_t[k]
            elif self.room[1] > 0 and self.cut and self.room[0] > 0:
                k = int(np.argmax(need_t))
                take = self._part(int(start[at[k]]), int(need_t[k]), int(prompt[at[k]]))
            elif not self.open:
                # Larger than the limits and not to be cut: a sequence of its own.
                k = 0
                take = need_t[k]
            if not take:
                yield from self.close()
                continue
            i = int(at[k])
            begin = int(start[i])
            end = begin + int(take)
            bears = max(0, end - max(begin, int(prompt[i])))
            self.open.append((i, begin, end - begin, self.sequence, m.tokens - int(self.room[0])))
            self.room -= (end - begin, 1, bears)
            if end == tokens[i]:
                keep = np.ones(len(at), bool)
                keep[k] = False
                at, need_t, need_l = at[keep], need_t[keep], need_l[keep]
            else:
                start[i] = end
                need_t[k] -= end - begin
                need_l[k] -= bears
            if self.room[0] <= 0 or self.room[1] <= 0:
                yield from self.close()

    def _part(self, begin: int, tokens: int, prompt: int) -> int:
        """How many tokens from ``begin`` on fit the room."""
        most = min(tokens, int(self.room[0]))
        return min(most, max(0, prompt - begin) + int(self.room[2]))


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int | None = None, limits: PackLimits | None = None,
    cut: bool = True, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
    repacked: int = REPACKED,
) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids, doc_tokens, loss, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers; ``id_array`` turns
    them into a list.

    Every scan partition encodes and packs its own documents block by block, so neither text
    nor ids are shuffled. Only its last, unfinished sequence is left over; these pieces
    (fewer tokens than one sequence per partition) are packed anew, ``repacked`` partitions
    at a time. Pieces lie gapless from offset 0, and a sequence holds at most
    ``limits.tokens`` tokens, ``limits.segments`` pieces and ``limits.loss`` loss-bearing
    tokens. ``loss_col`` says how many tokens at the end of a document bear loss; without
    it, all do.

    With ``cut`` a document is cut wherever a sequence is full; otherwise it stays whole, and
    one beyond the limits has a sequence of its own. A null text is empty and has only the
    end id; without end id, empty documents have no piece. Repeated rows are packed once
    each; null ids stay null; null or excessive loss counts mean all tokens; an empty table
    gives no rows; other columns are not read.
    """
    limits = limits or PackLimits()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, loss bigint, "
              "sequence_id bigint, `offset` bigint, part bigint, unfinished boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, held = Packer(limits, cut), []
        for batch in batches:
            id_type = batch.schema.field("id").type
            for block in split(batch, SLICE):
                flat, starts = encoded(encoder(tokenizer, end_id), block)
                ids = block.column("id").to_pylist()
                n = np.diff(starts)
                loss = n if loss_col is None else np.array(
                    [min(a, b) if b is not None else a for a, b in zip(n, block.column("loss").to_pylist())], np.int64)
                before = len(packer.open)  # pieces of earlier blocks, already in ``held``
                done = []
                for k, (i, start, length, sequence, offset) in enumerate(packer.pack(n, loss)):
                    done.append(held[k] if k < before else _piece(ids, flat, starts, loss, i, start, length, sequence, offset))
                fresh = packer.open if done else packer.open[before:]
                rest = [_piece(ids, flat, starts, loss, *p) for p in fresh]
                held = rest if done else held + rest
                if done:
                    yield _batch(done, part, False, id_type)
        if held:
            yield _batch(held, part, True, id_type)

    given = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        *([F.col(loss_col).cast("bigint").alias("loss")] if loss_col else []))
    pieces = stored(given.mapInArrow(run, schema), "pieces")

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        packer = Packer(limits, cut=False)
        lengths, loss = (table.column(c).to_numpy() for c in ("length", "loss"))
        placed = [*packer.pack(lengths, loss), *packer.close()]
        group = table.column("part")[0].as_py() // repacked
        out = table.take([p[0] for p in placed]).to_pydict()
        out["sequence_id"] = [((1 << 29 | group) << 33) | p[3] for p in placed]
        out["offset"] = [p[4] for p in placed]
        return pa.Table.from_pydict(out, table.schema)

    left = pieces.where("unfinished").groupBy(F.floor(F.col("part") / repacked)).applyInArrow(again, schema)
    return pieces.where("not unfinished").unionByName(left).drop("part", "unfinished")


def encoded(subwords: SubwordEncoder, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """What ``SubwordEncoder.encode`` gives for the texts of a block, made in slices of about ``SLICE`` bytes."""
    flat, sizes = [], []
    for part in split(block, SLICE):
        ids, starts = subwords.encode(part.column("text"))
        flat.append(ids)
        sizes.append(np.diff(starts))
        pa.default_memory_pool().release_unused()
    return np.concatenate(flat), np.cumsum(np.concatenate([[0], *sizes]))


def id_array(ids: Column) -> Column:
    """A piece's ids as an array of integers."""
    code = F.hex(ids)
    at = F.sequence(F.lit(0), F.floor(F.octet_length(ids) / 4).cast("int") - 1)
    # Little endian: the bytes of a number are read from the last to the first.
    return F.when(F.octet_length(ids) > 0, F.transform(at, lambda i: F.conv(F.concat(*[
        F.substr(code, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int"))).otherwise(
        F.array().cast("array<int>"))


def _piece(ids, flat, starts, loss, i, start, length, sequence, offset) -> tuple:
    first, total = int(starts[i]), int(starts[i + 1] - starts[i])
    bears = max(0, start + length - max(start, int(total - loss[i])))
    return ids[i], start, length, flat[first + start:first + start + length].tobytes(), total, bears, sequence, offset


def _batch(pieces: list[tuple], part: int, unfinished: bool, id_type: pa.DataType) -> pa.RecordBatch:
    doc, start, length, ids, total, bears, sequence, offset = zip(*pieces)
    whole = [pa.array(doc, id_type), *map(pa.array, (start, length)), pa.array(ids, pa.binary()), *map(pa.array, (total, bears)),
             pa.array([part << 33 | s for s in sequence]), pa.array(offset),
             pa.array([part] * len(doc)), pa.array([unfinished] * len(doc))]
    return pa.RecordBatch.from_arrays(whole, [
        "doc_id", "start", "length", "ids", "doc_tokens", "loss", "sequence_id", "offset", "part", "unfinished"])
