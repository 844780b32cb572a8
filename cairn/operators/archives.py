"""Archives: equal manifests, and archives whose entries all lie unpacked in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_hashes(entries: DataFrame) -> DataFrame:
    """archive, manifest for entries(archive, name, size, crc): a hash of the sorted entries, however they are packed."""
    item = F.concat_ws("|", "name", F.col("size").cast("string"), F.col("crc").cast("string"))
    return entries.groupBy("archive").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "\n").cast("binary"), 256).alias("manifest"), F.count("*").alias("entries"))


def manifest_groups(entries: DataFrame) -> DataFrame:
    hashed = manifest_hashes(entries)
    groups = hashed.groupBy("manifest").agg(F.count("*").alias("members")).where("members > 1")
    return hashed.join(groups, "manifest").select("manifest", "archive", "entries", "members")


def unpacked_archives(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """archive, entries of archives each of whose (lower name, size) is in the catalog: relational division."""
    have = catalog.select(F.lower("name").alias("name"), "size").distinct().withColumn("hit", F.lit(1))
    want = entries.select("archive", F.lower("name").alias("name"), "size")
    # Counting an archive's entries by key first keeps repeated names one row in the join.
    want = want.groupBy("archive", "name", "size").agg(F.count("*").alias("times"))
    out = want.join(have, ["name", "size"], "left").groupBy("archive").agg(F.sum("times").alias("entries"), F.count("*").alias("keys"), F.count("hit").alias("hits"))
    return out.where("keys = hits").select("archive", "entries")
