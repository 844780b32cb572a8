"""Which optional readers are there."""

from __future__ import annotations

import importlib.util
import shutil

from pyspark.sql import DataFrame, SparkSession

PROBES = (
    ("arrow", "pyarrow", True), ("numpy", "numpy", True), ("images", "PIL", False), ("raw images", "rawpy", False), ("pdf text", "pypdf", False),
    ("hwp text", "olefile", False), ("7z", "py7zr", False), ("ocr", "pytesseract", False), ("heic", "pillow_heif", False),
)
TOOLS = (("video frames", "ffmpeg"), ("audio prints", "fpcalc"))


def doctor(spark: SparkSession) -> DataFrame:
    """capability, needs, core, ok of the driver's machine."""
    rows = [(c, m, core, importlib.util.find_spec(m) is not None) for c, m, core in PROBES]
    rows += [(c, t, False, shutil.which(t) is not None) for c, t in TOOLS]
    return spark.createDataFrame(rows, "capability string, needs string, core boolean, ok boolean")
