"""Empty folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname


def empty_dirs(dirs: DataFrame, files: DataFrame, roots: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """path of folders dirs(path) with nothing but junk and empty folders below, from files(path, junk).

    An excluded folder (path) makes those above it non-empty. Roots are never reported.
    """
    full = files.where("not junk").select(F.explode(ancestors(F.col("path"))).alias("path"))
    if excluded is not None:
        full = full.union(excluded.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")))
    return dirs.select("path").where(~F.col("path").isin(roots)).join(full.distinct(), "path", "left_anti").distinct()


def maximal(empty: DataFrame) -> DataFrame:
    """Empty folders whose parent is not empty too."""
    parents = empty.select(F.col("path").alias("parent"))
    return empty.withColumn("parent", dirname(F.col("path"))).join(parents, "parent", "left_anti").select("path")
