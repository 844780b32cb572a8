"""Files that could not be read, as rows in place of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = 500


def error_log(files: DataFrame, result: str, message: str, at: Column) -> DataFrame:
    """path, error, at of files that have content but a null ``result``; a scan that writes this anew clears the old log."""
    return files.where(F.col("content").isNotNull() & F.col(result).isNull()).select("path", F.lit(message).alias("error"), at.cast("double").alias("at"))


def error_list(errors: DataFrame, first: int = FIRST) -> DataFrame:
    """path, error, at, rank of the first errors by time, and ``n_errors``, the count of all."""
    top = errors.orderBy("at", "path", "error").limit(first)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct("at", "path", "error"))).alias("e")).select(F.posexplode("e").alias("i", "e"))
    count = errors.agg(F.count("*").alias("n_errors"))
    return ranked.select("e.path", "e.error", "e.at", (F.col("i") + 1).alias("rank"), F.lit(1).alias("_k")).join(count.withColumn("_k", F.lit(1)), "_k").drop("_k")
