"""Writing results."""
from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def sink_text(df: DataFrame, path: str, text_col: str = "text") -> None:
    """Plain text, one line per row and per newline in the text; overwrites."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def sink_documents(df: DataFrame, path: str) -> None:
    """Parquet, so that a document stays one row; overwrites."""
    df.write.mode("overwrite").parquet(path)


def sink_tokens(df: DataFrame, path: str, output_format: str = "parquet") -> None:
    """Parquet; ``arrow`` is written as Parquet with a warning, others are refused."""
    wanted = output_format.lower()
    if wanted == "arrow":
        warnings.warn("arrow is not a Spark file format; writing parquet")
        wanted = "parquet"
    if wanted != "parquet":
        raise ValueError(f"unsupported output format {output_format!r}: use parquet")
    df.write.mode("overwrite").parquet(path)


def sink_task_records(records: DataFrame, path: str, partition_by: str = "iteration",
                      order: str = "seq") -> None:
    """JSON Lines of whole records with a write stamp, one folder per iteration.

    Rows are gathered by ranges of iteration and number first, so a folder does not get one
    file per task, and a very large iteration is written by several tasks.
    """
    stamped = records.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    stamped.repartitionByRange(partition_by, order).write.mode("overwrite").partitionBy(
        partition_by
    ).json(path)


def sink_run_metrics(summary: DataFrame, path: str) -> None:
    """Run summary rows as JSON with a write stamp."""
    summary.withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").json(path)


def load_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of a stored summary, for a resumed run."""
    return spark.read.schema("metric string, value double").json(path)
