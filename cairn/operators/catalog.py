"""Scan-time operators over a file listing (path, name, ext, size, mtime, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ranks import numbered
from ..functions.paths import glob_match, in_directory


def virtual_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document as one file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id",
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.lit(".txt").alias("ext"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1700000000) - (F.col("doc_id") * 7919 % 1000) * 86400).cast("double").alias("mtime"),
        F.col("text").alias("content"),
    )


def exclude(files: DataFrame, dirs: tuple[str, ...] = fixed.EXCLUDE_DIR_NAMES, globs: tuple[str, ...] = fixed.EXCLUDE_FILE_GLOBS) -> DataFrame:
    """Without files below an excluded folder or with an excluded name."""
    return files.where(~in_directory(F.col("path"), dirs) & ~glob_match(F.col("name"), globs))


def split_junk(files: DataFrame, globs: tuple[str, ...] = fixed.JUNK_GLOBS) -> DataFrame:
    """Adds ``junk``; junk is told before exclusion and size, and never enters the catalog."""
    return files.withColumn("junk", glob_match(F.col("name"), globs))


def junk_list(junk: DataFrame) -> DataFrame:
    """path, size, recommend, rank by size from the largest, and ``total_bytes`` of all."""
    total = junk.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.lit(1).alias("_k"))
    ranked = numbered(junk.select("path", "size", F.struct(F.negate("size").alias("s"), "path").alias("_by")), "_by", "rank")
    return ranked.select("path", "size", F.lit("move").alias("recommend"), "rank", F.lit(1).alias("_k")).join(F.broadcast(total), "_k").drop("_k")


def at_least(files: DataFrame, min_size: int = fixed.MIN_SIZE_BYTES) -> DataFrame:
    return files.where(F.col("size") >= min_size)


def skip_attributes(files: DataFrame) -> DataFrame:
    """Without reparse points and offline files, where the listing has those flags."""
    for flag in ("reparse", "offline"):
        if flag in files.columns:
            files = files.where(~F.coalesce(F.col(flag), F.lit(False)))
    return files


def outside_quarantine(files: DataFrame, quarantine: str | None) -> DataFrame:
    """Without what lies in the quarantine folder; an empty setting excludes nothing."""
    if not quarantine:
        return files
    return files.where(~F.startswith("path", F.lit(quarantine.rstrip("/") + "/")))


def one_per_inode(files: DataFrame) -> DataFrame:
    """Of hard links (dev, ino) the first path stays; inode 0 or null is unknown and passes."""
    first = F.row_number().over(W.partitionBy("dev", "ino").orderBy("path"))
    known = F.coalesce(F.col("ino"), F.lit(0)) != 0
    return files.where(known).withColumn("_first", first).where("_first = 1").drop("_first").unionByName(files.where(~known))


def catalog(files: DataFrame, min_size: int = fixed.MIN_SIZE_BYTES, quarantine: str | None = None) -> DataFrame:
    """The whole scan: attribute, quarantine, junk, exclusion and size tests in the order that decides membership."""
    kept = outside_quarantine(skip_attributes(files), quarantine)
    return at_least(exclude(split_junk(kept).where("not junk").drop("junk")), min_size)
