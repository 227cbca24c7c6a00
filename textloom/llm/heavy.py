"""Frequent values by Misra-Gries summaries, and grouping that splits them off."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.blocks import stored

# Counters of a summary. A digest with more than rows / (COUNTERS + 1) copies is always found,
# so no other group is larger, and a broadcast never holds more than COUNTERS rows.
COUNTERS = 4096


def _summary(values: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``counters`` values: sum per value, less the next largest count, positive ones only."""
    unique, at = np.unique(values, return_inverse=True)
    sums = np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)
    if len(unique) > counters:
        sums = sums - np.partition(sums, len(sums) - counters - 1)[len(sums) - counters - 1]
        unique, sums = unique[sums > 0], sums[sums > 0]
    return unique, sums


def frequent_values(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(value): every binary or bigint value held by more than rows / (counters + 1) rows, and perhaps others.

    One Misra-Gries summary per partition, batch by batch; summaries are merged by adding
    the counts of a value and taking off the largest count left out, which keeps the error
    bound of the whole. At most ``counters`` rows.
    """
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = counts = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch.column(0)
            new = rows.to_numpy() if pa.types.is_integer(rows.type) else np.array(rows.to_pylist(), f"V{len(rows[0].as_py())}")
            values = new if values is None else np.concatenate([values, new])
            counts = np.ones(len(new), np.int64) if counts is None else np.concatenate(
                [counts, np.ones(len(new), np.int64)])
            values, counts = _summary(values, counts, counters)
        if values is not None and len(values):
            kept = pa.array(values) if values.dtype.kind == "i" else pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([kept, pa.array(counts)], ["value", "n"])

    kind = df.schema[column].dataType.simpleString()
    sums = df.select(column).mapInArrow(summaries, f"value {kind}, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "value").limit(counters + 1)
    ranked = top.select("value", "n", F.min("n").over(Window.partitionBy()).alias("least"),
                        F.count("*").over(Window.partitionBy()).alias("size"))
    return ranked.where((F.col("size") <= counters) | (F.col("n") > F.col("least"))).select("value")


def with_group(
    rows: DataFrame, key: str, totals: dict[str, Column], smallest: int = 1, counters: int = COUNTERS
) -> DataFrame:
    """``rows`` of groups of at least ``smallest`` rows, with the group's size ``n`` and other totals.

    ``rows`` should be stored; ``key`` is a binary or bigint column without nulls. Frequent keys
    are found by summaries, counted exactly with map-side combining, and broadcast, at
    most ``counters`` of them, so their rows are decided where they lie. The rest is
    shuffled once, with at most rows / (counters + 1) rows to a key.
    """
    totals = {"n": F.count(F.lit(1)), **totals}
    found = stored(frequent_values(rows, key, counters).withColumnRenamed("value", key), "frequent")
    hot = stored(rows.join(F.broadcast(found), key).groupBy(key).agg(
        *[v.alias(k) for k, v in totals.items()]).where("n > 1"), "winners")
    marked = rows.join(F.broadcast(hot), key, "left")
    group = Window.partitionBy(key)
    cold = marked.where("n is null").select(*rows.columns, *[v.over(group).alias(k) for k, v in totals.items()])
    both = marked.where("n is not null").select(*cold.columns).unionByName(cold)
    return both if smallest <= 1 else both.where(F.col("n") >= smallest)
