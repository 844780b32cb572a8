"""Snapshots: what changed, merged catalog, reused fingerprints, bounded history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE, HISTORY = 1e-6, 50


def _same(old_size: Column, old_time: Column) -> Column:
    return (F.col("size") == old_size) & (F.abs(F.col("mtime") - old_time) < TOLERANCE)


def snapshot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (new, changed, reused, removed) by one full outer join on path."""
    before = old.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(1).alias("_old"))
    joined = before.join(new.select("path", "size", "mtime", F.lit(1).alias("_new")), "path", "full_outer")
    status = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "new").when(_same(F.col("old_size"), F.col("old_mtime")), "reused").otherwise("changed")
    return joined.select("path", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new catalog: unchanged files keep their hashes, others have null, missing ones are gone."""
    before = old.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("partial_hash").alias("_partial"), F.col("full_hash").alias("_full"))
    joined = new.join(before, "path", "left")
    same = _same(F.col("_size"), F.col("_mtime"))
    return joined.select("path", "size", "mtime", F.when(same, F.col("_partial")).alias("partial_hash"), F.when(same, F.col("_full")).alias("full_hash"))


def purged(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("path").join(new.select("path"), "path", "left_anti")


def reuse_fingerprints(files: DataFrame, cache: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cache rows count if size, mtime and the settings' digest are equal; empty results are cached too."""
    valid = cache.where(F.col("settings") == digest)
    hits = files.join(valid.drop("settings"), ["path", "size", "mtime"])
    misses = files.join(valid.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return hits, misses


def history_tail(history: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last entries by time; a bounded sort, then a rank over what is left."""
    last = history.orderBy(F.desc("at"), F.desc("id")).limit(keep)
    return last.withColumn("rank", F.row_number().over(W.orderBy(F.desc("at"), F.desc("id"))))
