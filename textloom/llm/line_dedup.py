"""Repeated passages of three lines: all but the first occurrence are removed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.llm.blocks import stored
from textloom.operators.skew import join_per_key

WINDOW = 3
# More hot windows than this are never broadcast: 40 bytes each.
HOT_WINDOWS = 100_000


def _windows(text: Column) -> Column:
    """(pos, a, b) of every run of three lines that are not all blank; a, b: a 128-bit hash."""
    def of(lines: Column) -> Column:
        def window(i: Column) -> Column:
            three = [F.get(lines, i + k) for k in range(WINDOW)]
            blank = F.trim(F.concat(*three), F.lit(" \t\r")) == ""
            return F.when(~blank, F.struct(
                i.alias("pos"), F.xxhash64(*three).alias("a"), F.xxhash64(F.lit(1), *three).alias("b")))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), window), lambda w: w.isNotNull())
    return let(F.split(text, "\n", -1), lambda lines: F.when(F.size(lines) >= WINDOW, of(lines)))


def _without(text: Column, starts: Column) -> Column:
    """(text, n_lines, n_removed) without the lines that the windows at ``starts`` cover."""
    def of(lines: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(*[p + k for k in range(WINDOW)]))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(lines).cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_removed"))
    return let(F.split(text, "\n", -1), of)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    lines_col: str | None = None, removed_col: str | None = None, hot_windows: int = HOT_WINDOWS,
) -> DataFrame:
    """``docs`` with every line removed that lies in a later occurrence of a repeated window.

    A window is three consecutive lines of one text, compared exactly. Its first occurrence,
    by id and position, stays, also where windows overlap; every line that any later
    occurrence covers goes. All rows and columns of ``docs`` stay; a text may end up empty.

    Windows travel as hashes. Counts and first places are combined map-side; windows that
    occur very often (at most ``hot_windows`` of them) are joined by broadcast, the rest
    by shuffle; the texts are shuffled once, to take the places of a document to it.

    A null text stays null with no lines; an empty text is one empty line. Windows of blank lines
    are never removed. Null ids come first in order. Rows that repeat both id and text are one
    document and get the same result; rows that repeat only the id are told apart by
    their text. An empty table gives no rows. ``lines_col`` and ``removed_col`` name
    counts to add; they replace columns of these names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    windows = stored(rows.select("id", "h", F.inline(_windows(F.col("text")))), "windows")
    total = windows.count()
    place = F.struct("id", "h", "pos")
    repeated = stored(windows.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    hot_rows = max(1000, total // hot_windows)
    later = join_per_key(windows, repeated, ["a", "b"], "n", total, hot_rows).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("pos").alias("starts"))
    joined = rows.join(starts, rows["id"].eqNullSafe(starts["_id"]) & (rows["h"] == starts["_h"]), "left")
    none = F.array().cast("array<int>")
    made = joined.select("row", F.inline(F.array(F.when(F.col("text").isNotNull(), F.when(
        F.col("starts").isNull(), F.struct(
            F.col("text").alias("text"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
            F.lit(0).cast("bigint").alias("n_removed"))).otherwise(
        _without(F.col("text"), F.coalesce("starts", none)))).otherwise(F.struct(
            F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_lines"),
            F.lit(0).cast("bigint").alias("n_removed"))))))
    added = {lines_col: "n_lines", removed_col: "n_removed"}
    keep = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
            for c in docs.columns if c not in added]
    return made.select(*keep, *[F.col(v).alias(k) for k, v in added.items() if k])
