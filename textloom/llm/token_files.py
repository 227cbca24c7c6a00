"""Token ids in ORC files: written in id order, read back by stripes, pruned by document id."""
from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.blocks import stored, text_blocks
from textloom.llm.subwords import BLOCK, encoder

# Stripes of 64 MB with an index entry per 10,000 rows; ids as run-length encoded integers, which
# a general compressor hardly makes smaller.
ORC_OPTIONS = {
    "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "10000", "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "none",
}


def id_lists(flat: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Ids as one list of int32 per text, without copying values one by one."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.astype("<i4", copy=False)))


def encode_documents(
    docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text and the end id, in the order of the rows."""
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = id_lists(*encoder(tokenizer, end_id).encode(batch.column("text")))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), ids.value_lengths().cast(pa.int64()), ids], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_blocks(docs, block, f"doc_id {kind}, n_tokens bigint, ids array<int>", id_col, text_col, block_bytes=2 * BLOCK)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", options: dict[str, str] | None = None,
) -> None:
    """Write (doc_id, n_tokens, ids) as ORC in ascending id order over all files.

    Texts are range-partitioned by id and sorted before they are encoded, as ids take more
    room in a shuffle than text. Null ids come first; rows that repeat an id stay next to
    each other; a null text is empty; an empty table writes files without rows.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encode_documents(ordered, tokenizer, end_id).write.options(**(ORC_OPTIONS | (options or {}))).orc(path)


def read_token_files(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of the files; with ``ids`` only these documents.

    A filter on ids reaches the reader, which skips files and stripes by their statistics
    and groups of rows by the Bloom filter. Unfiltered, each task reads its own stripes.
    """
    rows = spark.read.schema(spark.read.orc(path).schema).orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(list(ids)))


def with_checksums(rows: DataFrame, columns: Sequence[str], ids: str = "ids") -> DataFrame:
    """``columns`` and ids_crc32, the CRC-32 of each list as little-endian 32-bit integers."""
    def batches(given):
        for batch in given:
            lists = batch.column(ids)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = lists.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(crc, pa.int64())], [*columns, "ids_crc32"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, ids).mapInArrow(batches, f"{kinds}, ids_crc32 bigint")


def file_positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the files; start counts all ids before.

    Sums per file split give each split its offset; inside a split a window adds up rows.
    """
    rows = read_token_files(spark, path).select(
        "doc_id", "n_tokens", "ids",
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    )
    narrow = stored(with_checksums(rows, ["doc_id", "n_tokens", "file", "block", "row"]), "positions")
    splits = narrow.groupBy("file", "block").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        narrow.withColumn("here", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["file", "block"])
        .select("doc_id", (F.col("before") + F.col("here")).alias("start"), "n_tokens", "ids_crc32")
    )
