"""Running a function over blocks of whole texts inside Spark tasks."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.storage import CLEANUP, stored  # noqa: F401

# Texts of one call of a block function together hold about so many bytes (one text may hold more).
BLOCK_BYTES = 8 << 20


def text_blocks(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
    id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``fn`` over blocks of (id, text as UTF-8 bytes, extra columns); a null text is empty.

    Rows stay in their scan partition and in order; nothing is shuffled. A block ends once
    its texts reach ``block_bytes``, so memory does not depend on the size of a partition.
    """
    return df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *extra
    ).mapInArrow(in_blocks(fn, block_bytes), schema)


def in_blocks(fn, block_bytes: int = BLOCK_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in split(batch, block_bytes):
                yield fn(block)
    return run


def split(batch: pa.RecordBatch, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts reach ``block_bytes`` at their last row at the latest."""
    start = size = 0
    for i, n in enumerate(batch.column("text")):
        size += len(n.as_buffer() or b"")
        if size >= block_bytes:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
