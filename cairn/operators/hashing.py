"""Staged content hashing: size, then head and tail, then all bytes, each only for survivors of the stage before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

EDGE = 65_536


def partial_hash(size: Column, content: Column) -> Column:
    """Hash of the size, the first 64 KB and, above 128 KB, the last 64 KB."""
    data = content.cast("binary")
    tail = F.when(F.octet_length(data) > 2 * EDGE, F.substring(data, -EDGE, EDGE)).otherwise(F.lit(b""))
    return F.md5(F.concat(size.cast("string").cast("binary"), F.substring(data, 1, EDGE), tail))


def full_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def colliding(files: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys another row has too. Counts shuffle pre-aggregated; rows of a hot key are not gathered."""
    repeated = files.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return files.join(repeated, list(keys), "left_semi")


def staged_hashes(files: DataFrame) -> DataFrame:
    """path, size, mtime, partial_hash, full_hash; a hash is null where an earlier stage shows the file to be unique."""
    light = files.select("path", "size", "mtime")
    by_size = colliding(light, "size").select("path")
    partial = materialize(files.join(by_size, "path", "left_semi").select("path", "size", partial_hash(F.col("size"), F.col("content")).alias("partial_hash")), "partial")
    by_partial = colliding(partial, "size", "partial_hash").select("path")
    full = materialize(files.join(by_partial, "path", "left_semi").select("path", full_hash(F.col("content")).alias("full_hash")), "full")
    return light.join(partial.drop("size"), "path", "left").join(full, "path", "left")
