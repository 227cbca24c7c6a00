"""Spreading small inputs over all cores before CPU-heavy steps."""
from __future__ import annotations

from pyspark.sql import DataFrame

# Files that together hold less than this are worth moving once: it bounds the shuffle,
# whatever the number of cores.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame, *keys: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Hash-partition a small table over all cores; leave every other one as it is.

    A small table may sit in one file with one row group, where an expensive expression
    would run on one core. A table counts as small when it is read from fewer files than
    cores; these files are small themselves where their number times the size of a scan split
    stays below ``small_bytes``. Larger tables fill the cores already.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if files >= cores or files * split >= small_bytes:
        return df
    return df.repartition(cores, *keys)


def _bytes(size: str) -> int:
    """Bytes of a Spark size such as 134217728b or 16m."""
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    text = size.strip().lower().removesuffix("b") or "0"
    return int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)
