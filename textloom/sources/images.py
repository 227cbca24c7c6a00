"""Images as normalised pixel arrays."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.fixed_values import IMAGE_MEAN, IMAGE_STD

PRECISION = 22  # fixed-point bits of the resampling weights


def _weights(source: int, target: int) -> np.ndarray:
    """(target, source) integer weights of a triangle filter widened when shrinking."""
    scale = source / target
    width = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    low = np.maximum(0, (centre - width + 0.5).astype(int))
    high = np.minimum(source, (centre + width + 0.5).astype(int))
    at = np.arange(source)
    w = np.maximum(0.0, 1.0 - np.abs((at[None] - centre[:, None] + 0.5) / width))
    w[(at[None] < low[:, None]) | (at[None] >= high[:, None])] = 0.0
    w /= w.sum(axis=1, keepdims=True)
    return np.floor(w * (1 << PRECISION) + 0.5).astype(np.int64)


def _apply(weights: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    out = (np.tensordot(weights, pixels.astype(np.int64), axes=1) + (1 << PRECISION - 1)) >> PRECISION
    return np.clip(out, 0, 255)


def resize(pixels: np.ndarray, size: int) -> np.ndarray:
    """(height, width, channels) bytes to (size, size, channels): rows first, then columns."""
    if pixels.shape[1] != size:
        pixels = _apply(_weights(pixels.shape[1], size), pixels.swapaxes(0, 1)).swapaxes(0, 1)
    if pixels.shape[0] != size:
        pixels = _apply(_weights(pixels.shape[0], size), pixels)
    return pixels


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Decoded image bytes (blue, green, red, maybe alpha; or grey) as RGB."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def pixel_values(image: Column, size: int = 224) -> Column:
    """ARRAY<FLOAT> of 3·size·size channel-first values; null for a null image."""

    @F.pandas_udf("array<float>")
    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        mean = np.array(IMAGE_MEAN, np.float32)
        std = np.array(IMAGE_STD, np.float32)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.data is None or row.height <= 0:
                    out.append(None)
                    continue
                rgb = to_rgb(row.data, int(row.height), int(row.width), int(row.nChannels))
                scaled = resize(rgb, size).astype(np.float32) / np.float32(255)
                out.append(((scaled - mean) / std).transpose(2, 0, 1).ravel())
            yield pd.Series(out, dtype=object)

    return normalise(F.struct(
        image["height"].alias("height"), image["width"].alias("width"),
        image["nChannels"].alias("nChannels"), image["data"].alias("data"),
    ))


def scan_images(spark: SparkSession, path: str, size: int = 224) -> DataFrame:
    """(path, pixel_values) of the images below ``path``; undecodable ones are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(
        F.col("image.origin").alias("path"), pixel_values(F.col("image"), size).alias("pixel_values")
    )


def image_join(df: DataFrame, images: DataFrame, image_dir: str | None, image_col: str = "image",
               size: int = 224) -> DataFrame:
    """Attach ``pixel_values`` by path; a missing or bad image is blank, no image is null."""
    name = F.col(image_col)
    full = name if image_dir is None else F.when(
        name.startswith("/"), name
    ).otherwise(F.concat(F.lit(image_dir.rstrip("/") + "/"), name))
    keyed = images.select(
        F.regexp_replace("path", "^file:/+", "/").alias("_path"), "pixel_values"
    )
    blank = F.array_repeat(F.lit(0.0).cast("float"), 3 * size * size)
    named = df.where(name.isNotNull()).withColumn("_path", F.regexp_replace(full, "^file:/+", "/"))
    joined = named.join(keyed, "_path", "left").withColumn(
        "pixel_values", F.coalesce("pixel_values", blank)
    ).drop("_path")
    # Rows without an image would all be one join key.
    return joined.unionByName(df.where(name.isNull()), allowMissingColumns=True)
