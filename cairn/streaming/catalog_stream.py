"""A catalog that follows a folder of listings: each micro-batch is merged into a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LISTING = "path string, size long, mtime double"


def follow(spark: SparkSession, listings: str, versions: str, checkpoint: str):
    """Start a query that reads parquet listings(path, size, mtime) and writes versions/v=<batch>; the newest row of a path stays."""
    stream = spark.readStream.schema(LISTING).parquet(listings)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if number:
            batch = session.read.schema(LISTING).parquet(f"{versions}/v={number - 1}").withColumn("_n", F.lit(0)).unionByName(batch.withColumn("_n", F.lit(1)))
        else:
            batch = batch.withColumn("_n", F.lit(1))
        newest = F.row_number().over(W.partitionBy("path").orderBy(F.desc("_n"), F.desc("mtime"), F.desc("size")))
        batch.withColumn("_r", newest).where("_r = 1").select("path", "size", "mtime").write.mode("overwrite").parquet(f"{versions}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
