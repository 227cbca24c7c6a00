"""Lists of archive paths and fetching them."""
from __future__ import annotations

import shutil
import urllib.request
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip_blanks
from textloom.operators.positions import with_position
from textloom.operators.storage import cut
from textloom.sources.files import file_system

# Fixed value: where listed archive paths are fetched from by default.
BASE_URL = "https://data.commoncrawl.org/"
CHUNK = 1 << 20
TIMEOUT = 60


def manifest_entries(df: DataFrame, line: str = "value", order: list[str] | None = None) -> DataFrame:
    """(pos, path) in the given order; paths are stripped of blanks."""
    order = order or [line]
    rows = df.select(*order, strip_blanks(F.col(line)).alias("path"))
    return with_position(rows, order).select("pos", "path")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pos, path) of text files, gzip included: one entry per line, by file name and line.

    Large files are read in splits, which tasks pack in any order; the place of a line is its
    file, the start of its split and its number there.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return manifest_entries(cut(lines), order=["file", "block", "row"])


def manifest_head(manifest: DataFrame, n: int) -> DataFrame:
    """First ``n`` entries when n > 0, else all of them."""
    return manifest.orderBy("pos").limit(n) if n > 0 else manifest


def local_name(path):
    """File name for an archive path: slashes become underscores."""
    return F.replace(path, F.lit("/"), F.lit("_"))


def _open(uri: str):
    if uri.startswith(("http://", "https://")):
        return urllib.request.urlopen(uri, timeout=TIMEOUT)
    filesystem, path = file_system(uri)
    return filesystem.open_input_stream(path, compression=None)


def _copy(source: str, target: str) -> int:
    """Stream one file to shared storage; the final name appears only when complete.

    Attempts running at the same time write under names of their own.
    """
    filesystem, path = file_system(target)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with _open(source) as stream, filesystem.open_output_stream(partial, compression=None) as out:
        shutil.copyfileobj(stream, out, CHUNK)
    size = filesystem.get_file_info(partial).size
    filesystem.move(partial, path)
    return size


def fetch_report(manifest: DataFrame, output_dir: str, base_url: str = BASE_URL,
                 num_partitions: int = 200) -> DataFrame:
    """(path, status, bytes, error) after copying every entry below ``output_dir``.

    Any URI the workers can open is allowed; a failed fetch is reported, not raised.
    A repeated task writes the same file again. The folder must be shared storage.
    """
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name in zip(batch["path"], batch["name"]):
                try:
                    size = _copy(base_url + path, f"{output_dir.rstrip('/')}/{name}")
                    rows.append((path, "SUCCESS", size, None))
                except Exception as error:  # reported per path
                    rows.append((path, "FAILURE", None, str(error)[:500]))
            yield pd.DataFrame(rows, columns=["path", "status", "bytes", "error"]).astype({"bytes": "Int64"})

    named = manifest.select("path", local_name(F.col("path")).alias("name"))
    # Stored, so that a second action on the report does not fetch again.
    return cut(named.repartition(num_partitions, "path").mapInPandas(
        fetch, "path string, status string, bytes long, error string"
    ))
