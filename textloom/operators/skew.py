"""Joining many rows to one row per key when single keys may be huge."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.storage import cut

# A key with more rows than this is "hot". N rows hold at most N / HOT_ROWS hot keys,
# so the broadcast of hot keys stays below a million short rows up to 10^12 rows.
HOT_ROWS = 1_000_000


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    size_col: str,
    total_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row per key.

    ``size_col`` of ``per_key`` is the number of ``rows`` of that key. The hot keys are
    taken once, stored and broadcast, at most ``total rows / hot_rows`` of them. That
    join marks the rows of hot keys, which are finished where they lie; only unmarked rows
    are shuffled, so no task gets more than ``hot_rows`` rows of one key. Without hot keys, which
    ``total_rows`` may rule out beforehand, a plain join is planned. ``rows`` is
    read once for each kind of key: store it first if it is dear to compute.
    """
    keys = list(keys)
    if total_rows is not None and total_rows <= hot_rows:
        return rows.join(per_key, keys)
    hot = cut(per_key.where(F.col(size_col) > hot_rows).withColumn("_hot", F.lit(True)))
    if hot.isEmpty():
        return rows.join(per_key, keys)
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where("_hot is null").select(*rows.columns).join(
        per_key.where(F.col(size_col) <= hot_rows), keys)
    return marked.where("_hot").drop("_hot").unionByName(cold)


# Ids up to this many go to every executor; a long string id keeps that below 100 MB.
BROADCAST_IDS = 200_000


def join_ids(rows: DataFrame, ids: DataFrame, key: str, how: str,
             broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join of wide rows with a table of distinct ids.

    The ids are cut to storage and counted. Few of them are broadcast and the rows do not
    move; otherwise both sides are shuffled and sorted, which spills where it must.
    """
    stored = cut(ids.select(key))
    few = stored.count() <= broadcast_ids
    return rows.join(stored.hint("broadcast" if few else "merge"), key, how)
