"""Outcomes of code runs, given as a table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def execution_outcome(items: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``executed`` (null without a run, else all succeeded) and ``execution_score``.

    ``results`` has one row per code block with the item's keys and ``success``. Without
    any run the score is .5, after a failure 0, else 1.
    """
    per_item = results.groupBy(*keys).agg(F.bool_and("success").alias("executed"))
    return items.join(per_item, keys, "left").withColumn(
        "execution_score",
        F.when(F.col("executed").isNull(), 0.5).when(F.col("executed"), 1.0).otherwise(0.0),
    )
