"""Sources: file trees, zip listings, decisions."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import basename, extension

ENTRY = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("crc", T.LongType())]))


def file_tree(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, name, ext, size, mtime, content below the roots. Columns not selected are not read: listings skip content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(roots)
    name = basename(F.col("path"))
    return raw.select("path", name.alias("name"), extension(name).alias("ext"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")


@F.pandas_udf(ENTRY)
def zip_entries(content: pd.Series) -> pd.Series:
    """Files of a zip with size and CRC; null if it cannot be read."""

    def one(data):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return [{"name": i.filename, "size": i.file_size, "crc": i.CRC} for i in archive.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, OSError, TypeError, ValueError):
            return None

    return pd.Series([one(d) for d in content], dtype=object)


@F.pandas_udf(ENTRY)
def sevenzip_entries(content: pd.Series) -> pd.Series:
    """The same for 7z, where py7zr is installed; null otherwise."""

    def one(data):
        try:
            import py7zr

            with py7zr.SevenZipFile(io.BytesIO(data)) as archive:
                return [{"name": i.filename, "size": i.uncompressed, "crc": i.crc32} for i in archive.list() if not i.is_directory]
        except Exception:  # without the reader, or for a broken file, there is no listing
            return None

    return pd.Series([one(d) for d in content], dtype=object)


def archive_entries(files: DataFrame) -> DataFrame:
    """archive, name, size, crc of zip files(path, content)."""
    return files.select(F.col("path").alias("archive"), F.explode(zip_entries("content")).alias("e")).select("archive", "e.*")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """path, at of a decisions file {version, move: [path]}; of paths equal but for case and slashes the first stays."""
    raw = spark.read.schema("version int, move array<string>").option("multiLine", "true").json(path)
    rows = raw.select(F.posexplode("move").alias("at", "path"))
    key = F.lower(F.translate("path", "\\", "/"))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("at"))).where("_n = 1").select("path", "at")
