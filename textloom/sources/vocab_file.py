"""Vocabulary files: one JSON value of any size, read in pieces and returned as rows."""
from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.storage import cut
from textloom.sources.files import file_system

CHUNK = 1 << 20
ROWS = 20_000
# Commas tried as the end of the items that are parsed together.
MANY_TRIES = 4


class _Pieces:
    """Values of a JSON text that is read chunk by chunk; only what is not yet parsed is held."""

    def __init__(self, stream, chunk: int = CHUNK):
        self._stream, self._chunk, self._text, self._at, self._done = stream, chunk, "", 0, False
        self._tried = False  # whether items of this text could not be parsed together
        self._decode = codecs.getincrementaldecoder("utf-8")().decode
        self._json = json.JSONDecoder()
        self._pairs = json.JSONDecoder(object_pairs_hook=list)  # keys may be repeated

    def _more(self) -> None:
        data = self._stream.read(self._chunk)
        self._done = not data
        self._text, self._at = self._text[self._at:] + self._decode(data, self._done), 0
        self._tried = False

    def next_char(self) -> str:
        """The next character that is no blank, without taking it; '' at the end."""
        while True:
            while self._at < len(self._text) and self._text[self._at] in " \t\n\r":
                self._at += 1
            if self._at < len(self._text) or self._done:
                return self._text[self._at:self._at + 1]
            self._more()

    def take(self, wanted: str) -> str:
        found = self.next_char()
        if not found or found not in wanted:
            raise ValueError(f"expected one of {wanted!r} in the vocabulary, found {found!r}")
        self._at += 1
        return found

    def value(self):
        """The next whole value."""
        self.next_char()
        while True:
            try:
                found, end = self._json.raw_decode(self._text, self._at)
                follows = self._text[end:end + 1]
                # A number may go on in the next chunk.
                if self._done or (follows and not (isinstance(found, (int, float)) and follows in "0123456789.eE+-")):
                    self._at = end
                    return found
            except ValueError:
                if self._done:
                    raise
            self._more()

    def many(self, opening: str, closing: str) -> list:
        """Whole items up to a comma, parsed in one call; none if that cannot be done.

        A cut inside a string or a nested value leaves it open, so what parses are whole items.
        The comma stays. Items of an object are (key, value) pairs; the list ``tokens`` is not among them.
        """
        if not self._done and self._text.find(",", self._at) < 0:
            self._more()
        end = len(self._text)
        for _ in range(0 if self._tried else MANY_TRIES):
            end = self._text.rfind(",", self._at, end)
            if end < 0:
                break
            try:
                found = (self._pairs if opening == "{" else self._json).decode(opening + self._text[self._at:end] + closing)
            except ValueError:
                continue
            if not found or (opening == "{" and any(key == "tokens" for key, _ in found)):
                break
            self._at = end
            return found
        self._tried = True
        return []

    def items(self, closing: str) -> Iterator[None]:
        """Once before each item of an object or list whose opening mark has been taken."""
        if self.next_char() == closing:
            self.take(closing)
            return
        while True:
            yield
            if self.take("," + closing) == closing:
                return


def vocab_rows(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """(order, listed, token, id) of a vocabulary; a list begins with a row without a token."""
    pieces, order = _Pieces(stream, chunk), 0

    def entry(key, found):
        return order, False, key, found if type(found) is int and abs(found) < 1 << 63 else None

    pieces.take("{")
    for _ in pieces.items("}"):
        pairs = pieces.many("{", "}")
        for key, found in pairs:
            order += 1
            yield entry(key, found)
        if pairs:
            continue
        key = pieces.value()
        if not isinstance(key, str):
            raise ValueError(f"a key of the vocabulary is {key!r}")
        pieces.take(":")
        if key == "tokens" and pieces.next_char() == "[":
            pieces.take("[")
            yield order, True, None, None
            i = 0
            for _ in pieces.items("]"):
                for token in pieces.many("[", "]") or [pieces.value()]:
                    order += 1
                    yield order, True, str(token), i
                    i += 1
        else:
            found = pieces.value()
            order += 1
            yield entry(key, found)
    if pieces.next_char():
        raise ValueError("text after the vocabulary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            filesystem, place = file_system(path)
            with filesystem.open_input_stream(place, compression=None) as stream:
                rows = vocab_rows(stream)
                while part := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*part), (pa.int64(), pa.bool_(), pa.string(), pa.int64()))],
                        ["order", "listed", "token", "id"])


def scan_vocab_file(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a file with ``{token: id}`` or ``{"tokens": [...]}``; ids that are no integers are null.

    The file is one JSON value, so one task reads it, in chunks: its memory does not grow with
    the vocabulary, and no cell holds more than a token. Of a token that is repeated the last
    id counts. A file with a list of tokens is that list, whatever else it holds.
    """
    rows = cut(spark.createDataFrame([(path,)], "path string").mapInArrow(_read, "order bigint, listed boolean, token string, id bigint"))
    listed = not rows.where("listed").isEmpty()
    wanted = rows.where(F.col("listed") == F.lit(listed)).where("token is not null")
    return wanted.groupBy("token").agg(F.max_by("id", "order").alias("id"))
