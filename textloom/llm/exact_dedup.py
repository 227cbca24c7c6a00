"""Exact duplicates with frequent digests split off: found by Misra-Gries, joined by broadcast."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import stored
from textloom.llm.heavy import COUNTERS, with_group

def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when their SHA-256 is; null counts as empty. The row with the largest
    id of a group stays. Digests are stored once, without texts. Frequent digests are found
    by Misra-Gries summaries, counted exactly (combined map-side) and broadcast, so
    their rows are decided where they lie; all others are shuffled by digest, with at most
    rows / (counters + 1) rows in a group.

    A null id sorts below all others: it stays only where the whole group has null ids.
    Of rows that repeat the largest id all are marked kept, as an id names one document;
    an empty table gives no rows; other columns are not read.
    """
    digests = stored(docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
    ), "digests")
    decided = with_group(digests, "digest", {"keep_id": F.max("doc_id")}, counters=counters).withColumnRenamed("n", "group_size")
    return decided.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
