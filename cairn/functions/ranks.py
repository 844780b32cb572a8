"""Places in a total order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def numbered(keys: DataFrame, by: str, name: str) -> DataFrame:
    """keys, whose ``by`` are distinct, with their place in order, from 1: ranges are sorted in a task each and start after the sizes of those before them."""
    dealt = keys.repartitionByRange(by).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range, so one task holds them all.
    starts = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(by)) + F.col("_start")
    return dealt.join(F.broadcast(starts), "_range").select(*keys.columns, place.cast("int").alias(name))
