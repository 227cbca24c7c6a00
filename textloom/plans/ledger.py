"""Stages that run once: finished ones are known by a fingerprint of their settings and inputs."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Kept inside a stage's output; the name keeps readers of the folder away from it.
MARK = "_STAGE"
WORK = "._work"


def _at(spark: SparkSession, uri: str):
    """The file system of a path and the path, as Spark itself opens them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def listing(spark: SparkSession, paths: Sequence[str]) -> list[list]:
    """Per path: files, bytes, and a number that changes with any file's name, size or time.

    Only the listing is read, and added up by Spark; a missing path has no files.
    """
    out = []
    for uri in paths:
        system, path = _at(spark, uri)
        if not system.exists(path):
            out.append([uri, 0, 0, 0])
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select(
            "path", "length", F.unix_micros("modificationTime").alias("time"))
        sums = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "time"))).first()
        out.append([uri, sums[0], sums[1] or 0, sums[2] or 0])
    return out


def fingerprint(stage: str, settings: dict, inputs: list[list]) -> str:
    whole = json.dumps([stage, settings, inputs], sort_keys=True, default=str)
    return hashlib.sha256(whole.encode()).hexdigest()


def committed(spark: SparkSession, output: str) -> dict | None:
    """The mark of a finished stage's output, or None."""
    system, path = _at(spark, f"{output.rstrip('/')}/{MARK}")
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def run_once(
    spark: SparkSession, stage: str, settings: dict, inputs: Sequence[str], output: str, work: Callable[[str], dict | None],
) -> bool:
    """Run ``work(folder)`` unless ``output`` already holds its result; True where it ran.

    ``work`` writes to a folder beside ``output`` and may return counts for the mark. The
    mark is written last, then the folder takes the name of the output by one rename, so the output
    is whole or absent whenever a run is killed. A later run finds finished stages by their
    fingerprint and begins with the first other one. An output of an earlier fingerprint is replaced;
    a folder without a mark was not made here and is never touched.
    """
    output = output.rstrip("/")
    key = fingerprint(stage, settings, listing(spark, inputs))
    found = committed(spark, output)
    if found is not None and found["fingerprint"] == key:
        return False
    system, target = _at(spark, output)
    if found is None and system.exists(target) and len(system.listStatus(target)):
        raise FileExistsError(f"{output} holds files that no stage has finished")
    folder, hidden = target.getParent(), f"_{target.getName()}{WORK}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder, hidden)
    system.mkdirs(place)
    counts = work(place.toString())
    mark = {"stage": stage, "fingerprint": key, "settings": settings, "counts": counts or {},
            "finished": datetime.now(timezone.utc).isoformat()}
    stream = system.create(spark._jvm.org.apache.hadoop.fs.Path(place, MARK), True)
    stream.write(bytearray(json.dumps(mark, sort_keys=True, default=str).encode()))
    stream.close()
    if system.exists(target):
        system.delete(target, True)
    if not system.rename(place, target):
        raise OSError(f"cannot rename {place.toString()} to {output}")
    return True
