"""Web archives: an index of gzip members and records, and bodies read by byte ranges of it.

Archives are plain or gzip, usually with one member per record, and may be of any size. They
are read twice. The first pass cuts files into byte ranges, looks for the first
member in each, and follows the members from there; it yields the index, one narrow row per
record with type, address and status. Filters on those run on the index, which is Parquet, and only
the byte ranges of the records that are left are read again for their bodies.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.storage import scratch_path
from textloom.sources.files import file_system

INDEX = "path string, offset bigint, length bigint, rec_no int, rec_type string, uri string, http_status string, error string"
CHUNK = 1 << 20
SPLIT_BYTES = 128 << 20  # one byte range, and about what a task reads for bodies
OUT_BYTES = 16 << 20  # bodies of a batch
GZIP = b"\x1f\x8b\x08"
# How far a record's own headers may reach.
HEAD_BYTES = 1 << 16


def _plain_chunks(stream) -> Iterator[bytes]:
    """Decompressed bytes; gzip members may follow each other."""
    data = stream.read(CHUNK)
    if not data.startswith(b"\x1f\x8b"):
        while data:
            yield data
            data = stream.read(CHUNK)
        return
    inflate = zlib.decompressobj(31)
    while data:
        try:
            out = inflate.decompress(data, CHUNK)
        except zlib.error:
            # Skip to the next member; the cut record shows up as damaged.
            at = data.find(b"\x1f\x8b\x08", 1)
            while at < 0:
                data = stream.read(CHUNK)
                if not data:
                    return
                at = data.find(b"\x1f\x8b\x08")
            data, inflate = data[at:], zlib.decompressobj(31)
            continue
        if out:
            yield out
        if inflate.eof:
            data, inflate = inflate.unused_data, zlib.decompressobj(31)
        else:
            data = inflate.unconsumed_tail
        data = data or stream.read(CHUNK)


class _Buffer:
    """Reads lines and byte counts from a chunk iterator."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def line(self) -> bytes | None:
        start = 0
        while (at := self.held.find(b"\n", start)) < 0:
            start = len(self.held)
            if not self._more():
                at = len(self.held) - 1
                break
        if at < 0:
            return None
        out = bytes(self.held[: at + 1])
        del self.held[: at + 1]
        return out.rstrip(b"\r\n")

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def headers(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            name, _, value = line.partition(b":")
            out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        return out


def _http(block: bytes, decode: bool = True) -> tuple[str | None, bytes]:
    """Status code and body of an HTTP message, decoded unless that is not asked for."""
    buffer = _Buffer(iter([block]))
    parts = (buffer.line() or b"").split(None, 2)
    if len(parts) < 2 or not parts[0].startswith(b"HTTP/"):
        raise ValueError("no HTTP status line")
    headers = buffer.headers()
    body = bytes(buffer.held)
    if not decode:
        return parts[1].decode("latin-1"), body
    if headers.get("transfer-encoding", "").lower() == "chunked":
        body = _unchunk(body)
    encoding = headers.get("content-encoding", "").lower()
    if encoding in ("gzip", "deflate", "x-gzip"):
        body = zlib.decompress(body, 47)
    return parts[1].decode("latin-1"), body


def _unchunk(body: bytes) -> bytes:
    buffer, out = _Buffer(iter([body])), bytearray()
    try:
        while size := int((buffer.line() or b"0").split(b";")[0], 16):
            out += buffer.take(size)
            buffer.line()
    except ValueError:  # the header promised chunks the server did not send
        return body
    return bytes(out)


def read_records(stream, bodies: bool = True) -> Iterator[tuple]:
    """(rec_type, uri, http_status, body, error) of each record of one archive stream.

    Without ``bodies`` they are passed over undecoded and null.
    """
    buffer = _Buffer(_plain_chunks(stream))
    while (line := buffer.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        headers = buffer.headers()
        kind, uri = headers.get("warc-type"), headers.get("warc-target-uri")
        try:
            size = int(headers["content-length"])
            block = buffer.take(size)
            if len(block) < size:
                raise ValueError("record is cut off")
            status, body = None, block
            if kind == "response" and "http" in headers.get("content-type", "http"):
                status, body = _http(block, bodies)
            yield kind, uri, status, body if bodies else None, None
        except Exception as error:
            yield kind, uri, None, None, f"{type(error).__name__}: {error}"


class _Range:
    """Bytes of an open file from ``offset`` on, up to ``end`` where given."""

    def __init__(self, file, offset: int, end: int | None = None):
        self._file, self._at, self._end = file, offset, file.size() if end is None else end

    def read(self, n: int) -> bytes:
        data = _bytes(self._file, min(n, max(0, self._end - self._at)), self._at)
        self._at += len(data)
        return data


def _member_end(file, offset: int) -> int | None:
    """Where the gzip member at ``offset`` ends; None where none does or it holds no archive record."""
    stream, inflate, seen, size = _Range(file, offset), zlib.decompressobj(31), b"", 0
    while data := stream.read(CHUNK):
        size += len(data)
        try:
            while data:
                out = inflate.decompress(data, CHUNK)
                if len(seen) < 5:
                    seen += out[:5]
                    if seen[:5] != b"WARC/"[:len(seen)]:
                        return None
                data = inflate.unconsumed_tail
        except zlib.error:
            return None
        if inflate.eof:
            return offset + size - len(inflate.unused_data) if len(seen) == 5 else None
    return None


def _bytes(file, n: int, at: int) -> bytes:
    """Up to ``n`` bytes at a place, none beyond the end."""
    n = min(n, file.size() - at)
    return file.read_at(n, at) if n > 0 else b""


def _find(file, start: int, stop: int, mark: bytes) -> int | None:
    """The first place of ``mark`` that begins in [start, stop)."""
    at, held = start, b""
    while at < stop:
        data = held + _bytes(file, CHUNK, at + len(held))
        found = data.find(mark)
        if 0 <= found and at + found < stop:
            return at + found
        if found >= 0 or len(data) < len(held) + CHUNK:
            return None
        held = data[-len(mark) + 1:]
        at += len(data) - len(held)
    return None


def _head(record: tuple) -> tuple:
    """(rec_type, uri, http_status, error) of a record without its body."""
    kind, uri, status, _, error = record
    return kind, uri, status, error


def _gzip_members(file, start: int, stop: int) -> Iterator[tuple]:
    """(offset, length, records) of the members that begin in a byte range."""
    at = start
    while at < stop:
        end = _member_end(file, at) if _bytes(file, 3, at) == GZIP else None
        if end is None:  # the range begins inside a member, or this one is damaged
            at = _find(file, at + 1, stop, GZIP)
            if at is None:
                return
            continue
        yield at, end - at, [_head(r) for r in read_records(_Range(file, at, end), bodies=False)]
        at = end


def _plain_records(file, start: int, stop: int) -> Iterator[tuple]:
    """(offset, length, records) of the records of a plain archive that begin in a byte range.

    A record is known by what follows its length. At the place where one must begin, after
    another record or at the start of the file, one that is cut off counts too, as its headers.
    """
    at, due = start, start == 0
    while (found := _find(file, at, stop, b"WARC/")) is not None:
        due = due and found - at <= 8
        at = found
        if at and _bytes(file, 1, at - 1) != b"\n":
            at, due = at + 1, False
            continue
        data = _bytes(file, HEAD_BYTES, at)
        buffer = _Buffer(iter([data]))
        buffer.line()
        length = buffer.headers().get("content-length", "")
        head = len(data) - len(buffer.held)
        whole = head + int(length) if length.isdigit() else head
        follows = _bytes(file, 16, at + whole)
        ends = at + whole <= file.size() and (
            follows.startswith(b"\r\n\r\n") or follows.lstrip(b"\r\n")[:5] in (b"", b"WARC/"))
        if ends or due:
            whole = whole if ends else head
            yield at, whole, [_head(r) for r in read_records(_Range(file, at, at + whole), bodies=False)]
        at, due = at + (whole if ends else head), ends


def _index_ranges(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = file_system(uri)
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                with filesystem.open_input_file(row["path"]) as file:
                    members = _gzip_members if _bytes(file, 2, 0) == GZIP[:2] else _plain_records
                    for offset, length, records in members(file, row["start"], row["stop"]):
                        rows += [(row["path"], offset, length, i, *r) for i, r in enumerate(records)]
                names = ["path", "offset", "length", "rec_no", "rec_type", "uri", "http_status", "error"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)
    return run


def archive_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of all archive files below ``path``: path, offset, length, rec_no, rec_type, uri, http_status, error.

    ``offset`` and ``length`` are the bytes of the member, or of the record in a plain file;
    ``rec_no`` counts the records of a member. Every byte range of ``split_bytes`` is a row of
    its own for the tasks, so one large archive fills many. A range that begins inside
    a member may meet what looks like one, such as an archive stored in a body. Only
    the members that no earlier one covers are kept. Damaged members are left out; a damaged
    record has ``error`` set. The index is stored and can be kept for later scans.
    """
    filesystem, root = file_system(path)
    info = filesystem.get_file_info(root)
    files = [info] if info.is_file else filesystem.get_file_info(pafs.FileSelector(root, recursive=True))
    ranges = [
        (f.path, start, min(f.size, start + split_bytes))
        for f in files if f.is_file and not f.base_name.startswith((".", "_"))
        for start in range(0, f.size, split_bytes)
    ]
    # Small ranges share a task.
    tasks = max(1, min(len(ranges), sum(stop - start for _, start, stop in ranges) // split_bytes + spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(ranges, "path string, start bigint, stop bigint").repartition(tasks, "path", "start")
    found = listed.mapInArrow(_index_ranges(path), INDEX)
    earlier = Window.partitionBy("path").orderBy("offset").rangeBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.col("offset") + F.col("length")).over(earlier), F.lit(0))
    place = scratch_path(spark, f"archive-index-{uuid.uuid4().hex[:8]}")
    found.withColumn("covered", covered).where("offset >= covered").drop("covered").write.parquet(place)
    return spark.read.schema(INDEX).parquet(place)


def _bodies(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = file_system(uri)
        for batch in batches:
            rows, bodies, errors, size = batch.to_pylist(), [], [], 0
            done = 0
            for path, of_file in groupby(rows, key=lambda r: r["path"]):
                with filesystem.open_input_file(path) as file:
                    for (offset, length), wanted in groupby(of_file, key=lambda r: (r["offset"], r["length"])):
                        numbers = {r["rec_no"] for r in wanted}
                        for i, record in enumerate(read_records(_Range(file, offset, offset + length))):
                            if i in numbers:
                                bodies.append(record[3])
                                errors.append(record[4])
                                size += len(record[3] or b"")
                            if i >= max(numbers):
                                break
                        if size >= OUT_BYTES:
                            yield _with_bodies(batch.slice(done, len(bodies)), bodies, errors)
                            done, bodies, errors, size = done + len(bodies), [], [], 0
            yield _with_bodies(batch.slice(done), bodies, errors)
    return run


def _with_bodies(batch: pa.RecordBatch, bodies: list, errors: list) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != "error"]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in kept], pa.array(errors, pa.string()), pa.array(bodies, pa.binary())], [*kept, "error", "body"])


def scan_web_archive(
    spark: SparkSession, path: str, where: Column | str | None = None, bodies: bool = True,
    index: DataFrame | None = None, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """The rows of ``archive_index`` that meet ``where``, with ``body`` unless it is not asked for.

    The filter runs on the index. Bodies are read in file order, each task from byte
    ranges next to each other; a body that cannot be decoded is null and ``error`` says why.
    """
    index = archive_index(spark, path, split_bytes) if index is None else index
    wanted = index if where is None else index.where(where)
    if not bodies:
        return wanted
    size = wanted.where("rec_no = 0").agg(F.sum("length")).first()[0] or 0
    tasks = size // split_bytes + spark.sparkContext.defaultParallelism
    ordered = wanted.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset", "rec_no")
    return ordered.mapInArrow(_bodies(path), INDEX + ", body binary")


def scan_binary(spark: SparkSession, path: str):
    """(path, modificationTime, length, content) of whole files; small files share tasks."""
    return spark.read.format("binaryFile").load(path)
