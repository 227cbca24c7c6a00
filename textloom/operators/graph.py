"""Connected components of an edge table as a loop of joins and aggregations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.skew import HOT_ROWS, join_per_key
from textloom.operators.storage import cut

MAX_ROUNDS = 100


def _rehang(pairs: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """(node, other) rows with the least member ``low`` of each node's group attached."""
    low = pairs.groupBy("node").agg(
        F.least(F.col("node"), F.min("other")).alias("low"), F.count("*").alias("degree")
    )
    return join_per_key(pairs, low, ["node"], "degree", total, hot_rows)


def _state(edges: DataFrame) -> tuple[int, int]:
    """(edges, nodes that keep them from being stars around one least node each).

    In a star forest every node hangs below one node, and that one below none.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("dst", F.lit(0), F.lit(1))
    )
    per_node = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return tuple(per_node.agg(
        F.coalesce(F.sum("below"), F.lit(0)),
        F.count_if((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))),
    ).first())


def connected_components(
    edges: DataFrame, max_rounds: int = MAX_ROUNDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component = least node.

    Each round hangs the larger neighbours of a node below the least one, then the
    smaller neighbours (the large-star and small-star steps), which halves long chains
    instead of walking them. Only minima and counts are aggregated, so a node with
    a third of all edges combines map-side; its rows are joined by broadcast. Rounds
    end when only stars are left, which often holds at once, or in an error after
    ``max_rounds``.
    """
    current = cut(
        edges.select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        ).where("src <> dst").distinct()
    )
    for round_no in range(max_rounds + 1):
        total, tangled = _state(current)
        if not tangled:
            break
        if round_no == max_rounds:
            raise RuntimeError(f"no stars yet after {max_rounds} rounds")
        both = current.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(
            current.select(F.col("dst").alias("node"), F.col("src").alias("other"))
        )
        large = (
            _rehang(both, 2 * total, hot_rows)
            .where("other > node")
            .select(F.col("other").alias("node"), F.col("low").alias("other"))
        )
        small = _rehang(large, 2 * total, hot_rows)
        hung = small.select(F.col("other").alias("src"), F.col("low").alias("dst")).union(
            small.select(F.col("node").alias("src"), F.col("low").alias("dst"))
        )
        current = cut(hung.where("src <> dst").distinct())
    return (
        current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        .union(current.select("dst", "dst"))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )


def component_representative(components: DataFrame) -> DataFrame:
    """Least node of every component with the component's size."""
    return components.groupBy("component").agg(
        F.min("node").alias("representative"), F.count("*").alias("size")
    )
