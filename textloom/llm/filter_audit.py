"""What each filter removes in every order: filters measured once, orders counted from patterns of failures."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.blocks import stored, text_blocks
from textloom.llm.byte_transducer import measure

FILTERS = "ABCDE"
DUPLICATE = "E"
# A block costs about fifty bytes of memory for each of its bytes.
BLOCK = 2 << 20


@dataclass(frozen=True)
class AuditRule:
    """A: fewer words; B: a smaller percentage of distinct words; C: a larger one of capitals;
    D: any symbol; E: identical to a text with a smaller id."""

    min_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2

    def failures(self) -> dict[str, Column]:
        return {
            "A": F.col("n_words") < self.min_words,
            "B": 100 * F.col("n_distinct") < self.distinct_percent * F.col("n_words"),
            "C": 100 * F.col("n_capitals") > self.capital_percent * F.col("n_points"),
            "D": F.col("n_symbols") > 0,
        }


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, n_capitals, n_points, n_symbols) of every row.

    One pass over the bytes of whole texts; rows stay in their partition. A null text is
    empty and a null part the empty string.
    """
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        counts = measure(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
             *map(pa.array, counts.values())], ["doc_id", "part", "digest", *counts])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    return text_blocks(
        narrow, block, f"doc_id {kind}, part string, digest binary, n_words bigint, n_distinct bigint, "
        "n_capitals bigint, n_points bigint, n_symbols bigint", extra=("part",), block_bytes=BLOCK)


def failure_counts(docs: DataFrame, labels: DataFrame, rule: AuditRule = AuditRule(), id_col: str = "doc_id",
                   text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic, n): documents by the bit pattern of the filters they fail.

    Rows that agree are counted before anything is shuffled. A text passes E in the row
    with its least id, found per SHA-256 by a minimum that combines map-side; all others
    fail, so neither pairs nor groups of copies are made.
    """
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    fails = sum((F.when(c, bits[f]).otherwise(0) for f, c in rule.failures().items()), F.lit(0))
    rows = text_measures(docs, id_col, text_col, part_col).select("doc_id", "part", "digest", fails.alias("fails"))
    marks = labels.groupBy(F.col("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = stored(
        rows.groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n")).join(marks, "doc_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}), "failures")
    cell = ["part", "fails", "good", "toxic"]
    # Rows of the least id of a text, as one value per id; equal texts fail the same other filters.
    per_id = known.where("doc_id is not null").groupBy("digest", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct(*cell, "n"))).alias("cells"))
    least = per_id.groupBy("digest").agg(F.min(F.struct("doc_id", "cells")).alias("least"))
    passed = least.select(F.inline("least.cells")).unionByName(known.where("doc_id is null").select(*cell, "n"))
    with_e = F.col("fails") + bits[DUPLICATE]
    signed = (
        known.select(*cell, "n").withColumn("fails", with_e)
        .unionByName(passed.withColumns({"fails": with_e, "n": -F.col("n")}))
        .unionByName(passed)
    )
    return signed.groupBy(*cell).agg(F.sum("n").alias("n")).where("n > 0")


def filter_orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of all filters and step, from ``failure_counts``.

    A step depends on its filter and on the set before it only: these 80 cases are summed
    over the patterns, then the orders look them up in a table of fixed size.
    """
    spark = counts.sparkSession
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = [
        ("".join(p), k + 1, p[k], bits[p[k]], sum(bits[f] for f in p[:k]))
        for p in permutations(FILTERS) for k in range(len(p))
    ]
    steps = sorted({(bit, earlier) for *_, bit, earlier in orders})
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for b, e in steps]))
    rows = counts.withColumn("case", case).select("*", "case.bit", "case.earlier")
    hit, before = F.col("fails").bitwiseAND(F.col("bit")) > 0, F.col("fails").bitwiseAND(F.col("earlier")) > 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = rows.groupBy("part", "bit", "earlier").agg(
        total(~hit & ~before).alias("kept"), total(hit & ~before).alias("removed"), total(hit & before).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(hit & ~before & F.col("good")).alias("good_lost"), total(hit & ~before & F.col("toxic")).alias("toxic_lost"))
    table = spark.createDataFrame(orders, "filter_order string, step int, filter string, bit int, earlier int")
    each = Window.partitionBy("part", "filter")
    return sums.join(F.broadcast(table), ["bit", "earlier"]).select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(each).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, rule: AuditRule = AuditRule(), id_col: str = "doc_id",
                 text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Kept and removed documents of every part, for all orders of the five filters.

    ``labels`` has doc_id, quality and toxic; ids without a label count as neither, and of
    repeated ones the largest counts. Rows that repeat an id are documents of their own; of
    several with one text none is a copy of the others, for no id is smaller. A row without
    an id has no smaller id and never fails E. Null and empty texts have no words: they fail
    A, pass B to D, and are copies of each other. Texts are compared by SHA-256. An empty table
    gives no rows; other columns are not read.
    """
    return filter_orders(failure_counts(docs, labels, rule, id_col, text_col, part_col))
