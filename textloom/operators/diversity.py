"""How alike each task is to the closest earlier task of its iteration.

Likeness is .2, .4 and .4 times the Jaccard similarity of the word 1-, 2- and 3-grams; two
empty sets count as equal.

* Tasks with the same words are collapsed first: all but the first of them score 1.
* Iterations of few tasks are packed into one bundle each and compared inside one
  expression that returns only the best earlier task per member.
* Larger iterations are searched by inverted lists of n-grams (``nearest.py``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import blank_words, let, word_ngrams
from textloom.operators.nearest import BLOCK, SHORT, nearest_earlier
from textloom.operators.skew import HOT_ROWS, join_per_key
from textloom.operators.storage import cut

NGRAM_WEIGHTS = (0.2, 0.4, 0.4)
BUNDLE = 256


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets in lambda variables; 1 when both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda shared: F.coalesce(
        F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(1.0)
    ))


def task_similarity(a: Column, b: Column, weights: Sequence[float] = NGRAM_WEIGHTS) -> Column:
    """Weighted n-gram likeness of two gram structs g1, g2, ..."""
    total = F.lit(0.0)
    for n, weight in enumerate(weights, 1):
        total = total + F.lit(float(weight)) * set_similarity(a[f"g{n}"], b[f"g{n}"])
    return total


def _best(members: Column, others: Column, weights: Sequence[float]) -> Column:
    """Per member the most similar earlier one: array of (seq, similarity, prev)."""

    def closest(cur: Column) -> Column:
        earlier = F.filter(others, lambda prev: prev["seq"] < cur["seq"])
        found = F.transform(earlier, lambda prev: F.struct(
            task_similarity(cur, prev, weights).alias("similarity"), (-prev["seq"]).alias("order")
        ))
        best = F.array_max(found)
        return F.struct(
            cur["seq"].alias("seq"), best["similarity"].alias("similarity"),
            (-best["order"]).alias("prev"),
        )

    return F.transform(members, closest)


def _bundles(listed: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """One row per key with its members: first sequence number and n-gram sets."""
    member = F.struct(F.col("first").alias("seq"), *[
        word_ngrams(F.col("listed"), n).alias(f"g{n}") for n in range(1, longest + 1)
    ])
    return listed.groupBy(*keys).agg(F.collect_list(member).alias("members"))


# The outer generators keep Catalyst from testing the size of an array it would have to
# compute twice for that; no bundle is empty.
def _within(bundles: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Members of each bundle compared with each other."""
    found = _best(F.col("members"), F.col("members"), weights)
    return bundles.select("iteration", F.inline_outer(found)).select(
        "iteration", "seq", F.col("similarity").alias("max_similarity"), F.col("prev").alias("closest_seq")
    )


def closest_earlier_task(
    tasks: DataFrame, iteration: str = "iteration", seq: str = "seq", text: str = "task",
    weights: Sequence[float] = NGRAM_WEIGHTS, bundle: int = BUNDLE,
    total_rows: int | None = None, hot_rows: int = HOT_ROWS, short: int = SHORT, block: int = BLOCK,
) -> DataFrame:
    """(iteration, seq, max_similarity, closest_seq); nulls for an iteration's first task.

    ``closest_seq`` is the earliest of the most similar tasks. Weights must not be
    negative, so that equal word lists are never beaten. Iterations of more than ``bundle``
    different tasks are searched by inverted lists, with ``short`` and ``block`` of
    ``nearest_earlier``; the result is the same.
    """
    if min(weights) < 0:
        raise ValueError("n-gram weights must not be negative")
    words = blank_words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    rows = tasks.select(
        F.col(iteration).alias("iteration"), F.col(seq).alias("seq"),
        F.array_join(words, " ").alias("words"),
    )
    firsts = cut(rows.groupBy("iteration", "words").agg(
        F.min("seq").alias("first"), F.count("*").alias("copies")
    ))
    sizes = firsts.groupBy("iteration").agg(
        F.count("*").alias("tasks"), F.max("copies").alias("copies")
    )
    largest, most_copies = sizes.agg(F.max("tasks"), F.max("copies")).first()
    listed = firsts.withColumn("listed", F.when(
        F.col("words") == "", F.array().cast("array<string>")
    ).otherwise(F.split("words", " ")))
    if (largest or 0) <= bundle:
        best = _within(_bundles(listed, ["iteration"], len(weights)), weights)
    else:
        placed = join_per_key(listed, sizes.select("iteration", "tasks"), ["iteration"], "tasks", total_rows, hot_rows)
        split = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))
        grams = [word_ngrams(split, n) for n in range(1, len(weights) + 1)]
        found = nearest_earlier(
            placed.where(F.col("tasks") > bundle).select(
                F.col("iteration").alias("grp"), F.col("first").alias("place"), "words"),
            weights, short, block, total_rows, hot_rows, grams)
        best = _within(_bundles(placed.where(F.col("tasks") <= bundle), ["iteration"], len(weights)), weights).unionByName(
            found.select(F.col("grp").alias("iteration"), F.col("place").alias("seq"), F.col("similarity").alias("max_similarity"),
                         F.col("prev").alias("closest_seq")))
    if (most_copies or 0) > 1:
        first_of = firsts.where("copies > 1")
        copies = join_per_key(
            rows, first_of, ["iteration", "words"], "copies", total_rows, hot_rows
        ).where(F.col("seq") > F.col("first"))
        best = best.unionByName(copies.select(
            "iteration", "seq", F.lit(float(sum(weights))).alias("max_similarity"),
            F.col("first").alias("closest_seq"),
        ))
    return best.withColumnsRenamed({"iteration": iteration, "seq": seq})
