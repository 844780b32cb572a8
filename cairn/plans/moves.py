"""Move, undo and purge plans as tables; nothing is moved here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import dirname, extension


def move_plan(items: DataFrame, base: str, stamp: str, per_drive: bool = False) -> DataFrame:
    """src, dest for items(path): base/stamp/drive/rest; targets that clash, whatever their case, get _1, _2 ... by path."""
    src = F.translate("path", "\\", "/")
    drive = F.regexp_extract(src, "^([A-Za-z]):", 1)
    rest = F.regexp_replace(src, "^([A-Za-z]:)?/*", "")
    if per_drive:
        top = F.concat(F.when(drive != "", F.concat(drive, F.lit(":"))).otherwise(""), F.lit(f"/{base.rstrip('/').rsplit('/', 1)[-1]}/{stamp}/"))
    else:
        top = F.concat(F.lit(f"{base.rstrip('/')}/{stamp}/"), F.when(drive != "", drive).otherwise("root"), F.lit("/"))
    planned = items.select(F.col("path").alias("src"), F.concat(top, rest).alias("want"))
    n = F.row_number().over(W.partitionBy(F.lower("want")).orderBy("src")) - 1
    ext = extension(F.substring_index("want", "/", -1))
    head = F.substr("want", F.lit(1), F.char_length("want") - F.char_length(ext))
    tail = F.substr("want", F.char_length(head) + 1, F.char_length(ext))
    return planned.withColumn("n", n).select("src", F.when(F.col("n") == 0, F.col("want")).otherwise(F.concat(head, F.lit("_"), F.col("n").cast("string"), tail)).alias("dest"))


def undo_plan(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """src, dest, action for manifest(src, dest): restore if dest is there and src is free, else why not."""
    paths = existing.select(F.col("path").alias("_p")).distinct()
    there = manifest.join(paths.withColumn("_d", F.lit(True)), F.col("dest") == F.col("_p"), "left").drop("_p")
    there = there.join(paths.withColumn("_s", F.lit(True)), F.col("src") == F.col("_p"), "left").drop("_p")
    action = F.when(F.col("_d").isNull(), "missing").when(F.col("_s").isNotNull(), "occupied").otherwise("restore")
    return there.select("src", "dest", action.alias("action"))


def purge_preview(files: DataFrame, root: str, as_of: float, days: int) -> DataFrame:
    """folder, bytes, n_files of first-level quarantine folders whose newest file is older than so many days (1 or more)."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    below = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    folder = F.substring_index(F.substr("path", F.lit(len(root.rstrip("/")) + 2)), "/", 1)
    return below.groupBy(folder.alias("folder")).agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("n_files"), F.max("mtime").alias("newest")).where(F.col("newest") < as_of - days * 86400.0).drop("newest")


def calibration(pairs: DataFrame) -> DataFrame:
    """max_intra, min_inter, threshold (their middle) from pairs(distance, same)."""
    out = pairs.agg(F.max(F.when(F.col("same"), F.col("distance"))).alias("max_intra"), F.min(F.when(~F.col("same"), F.col("distance"))).alias("min_inter"))
    return middle(out)


def middle(extremes: DataFrame) -> DataFrame:
    """Adds ``threshold``, the middle of max_intra and min_inter."""
    return extremes.withColumn("threshold", (F.col("max_intra") + F.col("min_inter")) / 2)


def by_folder(plan: DataFrame) -> DataFrame:
    return plan.groupBy(dirname(F.col("dest")).alias("folder")).agg(F.count("*").alias("n"))
