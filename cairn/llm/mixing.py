"""Mixing sources to target weights by distributed prefix sums over hash-random keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..session import materialize

BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Key ranges that each source is dealt into; one range is sorted by one task.
RANGES = 1024
MOST_EPOCHS = 3


def n_words(text: Column) -> Column:
    """Words of a text, split at blanks; 0 for null."""
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from sizes(source, source_size), one row a source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the
    total of all sizes. A target stops at ``epochs`` times its source's size;
    what is cut off is shared again by weight until no target is above. Each
    round is one sum over the sources: those that the present level lifts over
    their cap keep it, and the level of the rest rises. Only sums reach the
    driver, and the sources are numbered in ranges, so there may be any number.
    """
    by_code = F.struct(F.col("source").isNull(), F.encode("source", "UTF-8"))
    placed = numbered(sizes.withColumn("by_code", by_code), "by_code", "place")
    weight, cap = ((F.col("place") - 1) % 3 + 1).cast("long"), F.col("source_size") * epochs
    weighed = materialize(placed.select("source", "source_size", weight.alias("weight"), cap.alias("cap")), "weights")
    total, heavy = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = total
    while True:
        # Products in decimals: they may pass the range of long.
        capped = F.col("cap").cast("decimal(19,0)") * F.lit(heavy).cast("decimal(19,0)") <= F.lit(left).cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
        cut, rest = weighed.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if rest in (0, heavy):
            break
        left, heavy = total - cut, rest
    return weighed.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(left).cast("double") * F.col("weight") / F.lit(heavy)).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, seed: int = 7, ranges: int = RANGES, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of docs(doc_id, text, source).

    size: what a document counts, its words if not given. Every document gets a
    hash-random key from its id, text and ``seed``. Within its source, in key order, whole
    rounds over all documents are taken as long as they fit the target; of the
    next round the documents are taken up to the exact word where the budget
    ends, so the words taken are the target rounded down, and no document is
    taken more than ``epochs`` times.

    The key space is cut into ``ranges`` equal ranges. Range totals are summed
    first, and each range then starts from the total of the ranges before it, so
    a source of any size is spread over many tasks.

    Null or blank texts have size 0 and nothing taken. A null source is a source
    of its own. Repeated rows are documents of their own; equal keys are ordered
    by doc_id, and among identical rows the order is of no effect on their sum.
    An empty table gives an empty table. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (n_words(text) if size is None else size).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("key"))
    rows = rows.withColumn("range", F.floor((F.shiftrightunsigned("key", 1) / F.lit(2.0**63)) * ranges).cast("int"))
    # Nulls group and join like a value of their own.
    rows = materialize(rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
    totals = materialize(rows.groupBy("name", "source", "range").agg(F.sum("size").alias("total")), "ranges")
    targets = source_targets(totals.groupBy("source").agg(F.sum("total").alias("source_size")), epochs).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    starts = totals.withColumn("start", F.sum("total").over(W.partitionBy("name").orderBy("range")) - F.col("total")).join(targets, "name").drop("total", "source")
    starts = materialize(starts, "starts")
    within = W.partitionBy("name", "range").orderBy(F.shiftrightunsigned("key", 1), "key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = rows.withColumn("inside", F.sum("size").over(within) - F.col("size"))
    placed = ordered.join(starts, ["name", "range"])
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("start") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * rounds + part).cast("long").alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
