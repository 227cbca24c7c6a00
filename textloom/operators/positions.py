"""Global positions and running totals without a single-task window.

Rows are range-partitioned and sorted, then cut to shared storage so that both passes
see the same partitions. Each partition's totals (one row per partition) give the offset
of the next ones; inside a partition a window per partition number does the rest.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.storage import cut

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id: partition above, row below


def _ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(
        "_row", F.monotonically_increasing_id()
    ).withColumn("_part", F.shiftright("_row", 33)).withColumn(
        "_row", F.col("_row").bitwiseAND(F.lit(_LOW_BITS))
    )


def _offsets(per_part: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals of all earlier partitions; the input has one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns
    ])


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the given total order."""
    rows = _ordered(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    return (
        rows.join(F.broadcast(_offsets(sizes, ["n"])), "_part")
        .withColumn(name, F.col("_before_n") + F.col("_row"))
        .drop("_part", "_row", "_before_n")
    )


def with_running_totals(
    df: DataFrame, order: Sequence[str], sums: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Add running sums over a total order, with or without the current row."""
    rows = _ordered(df, order)
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    window = Window.partitionBy("_part").orderBy("_row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    inside = rows.select("*", *[
        F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"_in_{k}") for k, c in sums.items()
    ])
    joined = inside.join(F.broadcast(_offsets(parts, list(sums))), "_part")
    return joined.select(*df.columns, *[
        (F.col(f"_before_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums
    ])
