"""Image files, decoded by Spark's own image source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import IMAGE_EXTS
from ..operators.media import pixel_hash
from ..session import ship


#: Names of image files, in either case: other files are not read as images.
NAMES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext[1:]) for ext in IMAGE_EXTS) + "}"


@F.pandas_udf(T.ArrayType(T.FloatType()))
def gray(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Luma of pixels in blue, green, red (and alpha) order; one channel stays as it is."""

    def one(raw, n):
        pixels = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(np.int64)
        if n == 1:
            return pixels[:, 0].astype(np.float32)
        return ((pixels[:, 2] * 19595 + pixels[:, 1] * 38470 + pixels[:, 0] * 7471 + 0x8000) >> 16).astype(np.float32)

    return pd.Series([one(*x) for x in zip(data, channels, strict=True)], dtype=object)


def image_pixels(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, pixels (gray), height, width of PNG, JPEG, GIF and BMP files below the roots; what cannot be decoded is left out."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(roots).select("image.*")
    return raw.select(F.col("origin").alias("path"), gray("data", "nChannels").alias("pixels"), "height", "width")


def image_prints(spark: SparkSession, roots: list[str], kind: str = "dhash", rotation: bool = False) -> DataFrame:
    """path, img (one 64-bit word) of image files."""
    ship(spark)
    return image_pixels(spark, roots).select("path", pixel_hash(kind, rotation)("pixels", "height", "width").alias("img"))
