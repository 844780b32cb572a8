"""Equality groups: exact duplicates, name conflicts and shared fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keeper import keeper


def content_key(full_hash: Column, path: Column) -> Column:
    """Equal for equal content; a file without hash is unique."""
    return F.when(F.coalesce(full_hash, F.lit("")) != "", F.concat(F.lit("h:"), full_hash)).otherwise(F.concat(F.lit("u:"), path))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """group_id, path, size, mtime, members, reclaimable, role for files(path, size, mtime, full_hash)."""
    able = files.where("full_hash is not null and full_hash <> '' and size > 0")
    groups = able.groupBy("full_hash").agg(F.count("*").alias("members"), keeper().alias("keep")).where("members > 1")
    out = able.join(groups, "full_hash")
    return out.select(F.col("full_hash").alias("group_id"), "path", "size", "mtime", "members", (F.col("size") * (F.col("members") - 1)).alias("reclaimable"), F.when(F.col("path") == F.col("keep"), "keep").otherwise("move").alias("role"))


def reclaimable(groups: DataFrame) -> DataFrame:
    """One row: groups and bytes of their non-keepers."""
    moved = groups.where("role = 'move'")
    return moved.agg(F.count_distinct("group_id").alias("n_groups"), F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def name_conflicts(files: DataFrame) -> DataFrame:
    """Files (path, name, key) whose name, whatever its case, has two or more contents; all are for review."""
    low = files.withColumn("lower_name", F.lower("name"))
    groups = low.groupBy("lower_name").agg(F.count("*").alias("members"), F.count_distinct("key").alias("contents")).where("members > 1 and contents > 1")
    return low.join(groups, "lower_name").select("lower_name", "path", "members", "contents", F.lit("review").alias("role"))


def same_fingerprint(files: DataFrame, fingerprint: str) -> DataFrame:
    """Groups with one fingerprint but not one content: group_id, path, members, role."""
    able = files.where(F.col(fingerprint).isNotNull())
    groups = able.groupBy(fingerprint).agg(F.count("*").alias("members"), F.count_distinct("key").alias("contents"), keeper().alias("keep")).where("members > 1 and contents > 1")
    return able.join(groups, fingerprint).select(F.col(fingerprint).alias("group_id"), "path", "members", F.when(F.col("path") == F.col("keep"), "keep").otherwise("move").alias("role"))


def labelled_groups(files: DataFrame, labels: DataFrame, identity: str | None = None) -> DataFrame:
    """Groups from labels(path, component): two members or more, not all of one content, nor of one ``identity``."""
    joined = files.join(labels, "path")
    tests = [F.count("*").alias("members"), F.count_distinct("key").alias("contents"), keeper().alias("keep")]
    tests += [F.count_distinct(identity).alias("kinds")] if identity else [F.lit(2).alias("kinds")]
    groups = joined.groupBy("component").agg(*tests).where("members > 1 and contents > 1 and kinds > 1")
    return joined.join(groups, "component").select(F.col("component").alias("group_id"), "path", "members", F.when(F.col("path") == F.col("keep"), "keep").otherwise("move").alias("role"))
