"""Storage insights over a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import NO_EXTENSION
from ..functions.paths import ancestors

TOP, TOP_FOLDERS, STALE_DAYS = 60, 40, 730


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def _ranked(df: DataFrame, k: int, *order) -> DataFrame:
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def largest(files: DataFrame, k: int = TOP) -> DataFrame:
    return _ranked(files.select("path", "size"), k, F.desc("size"), "path")


def stale(files: DataFrame, as_of: float, days: int = STALE_DAYS, k: int = TOP) -> DataFrame:
    """Largest files not changed for so many days; a mtime of 0 or null is unknown."""
    old = files.where((F.coalesce("mtime", F.lit(0.0)) != 0) & (F.col("mtime") < as_of - days * 86400.0))
    return _ranked(old.select("path", "size", "mtime"), k, F.desc("size"), "path")


def by_extension(files: DataFrame) -> DataFrame:
    ext = F.when(F.coalesce("ext", F.lit("")) == "", NO_EXTENSION).otherwise(F.col("ext"))
    return files.groupBy(ext.alias("ext")).agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("n_files"))


def folder_rollup(files: DataFrame, k: int | None = TOP_FOLDERS) -> DataFrame:
    """Bytes and files below every folder. Sizes are first summed by folder, so hot ancestors add few rows."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    leaf = files.groupBy(folder.alias("leaf")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n_files"))
    up = leaf.select(F.explode(ancestors(F.concat("leaf", F.lit("/x")))).alias("folder"), "bytes", "n_files")
    out = up.groupBy("folder").agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("n_files").alias("n_files"))
    return out if k is None else _ranked(out, k, F.desc("bytes"), "folder")
