"""All pairs of rows, block by block, and pairs of copies: bounded memory, dealt over all cores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Copies of one content that are expanded together.
CHUNK = 500


def block_pairs(rows: DataFrame, count: int, most: int, compare: Callable[[pa.StructArray, pa.StructArray, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``compare`` yields for each two blocks of rows(id, tag, ...) of one tag.

    Rows are dealt by hash into blocks of about ``most`` rows, of which
    ``count`` is the number in the largest tag. Each two blocks, and each block
    with itself (``own``), are one piece of work: a task holds two blocks, and
    the pieces are dealt evenly, whatever the contents are.
    """
    ship(rows.sparkSession)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-count // most), min(round((6 * cores) ** 0.5), -(-count // 512)), 1)
    row = F.struct(*[c for c in rows.columns if c != "tag"])
    packed = rows.select("tag", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), row.alias("row")).groupBy("tag", "block").agg(F.collect_list("row").alias("rows"))
    sent = packed.select("tag", "block", "rows", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = sent.select("tag", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("block", "rows").alias("side"))
    # A number of partitions that is given is not coalesced: the rows are few, the work is not.
    met = sent.repartition(min(blocks * (blocks + 1) // 2, 10_000), "tag", "i", "j").groupBy("tag", "i", "j").agg(F.collect_list("side").alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sides in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = [x.values for x in sides.values.flatten()[1]]
                if own:
                    yield from compare(held[0], held[0], True)
                elif len(held) == 2:
                    yield from compare(held[0], held[1], False)

    return met.select((F.col("i") == F.col("j")).alias("own"), "sides").mapInArrow(run, schema)


def matrix(words: pa.ListArray) -> np.ndarray:
    """Arrays of equal length as rows."""
    return words.flatten().to_numpy(zero_copy_only=False).reshape(len(words), -1)


def expanded(near: DataFrame, members: DataFrame, most: int, value: str, zero) -> DataFrame:
    """a, b, value of all pairs a < b, from near(a, b, value) between heads and members(head, id, copies).

    Members of one head are at ``zero`` from each other. They go by chunks, so
    that neither a task nor a key holds all pairs of a large class; ``most`` is
    the size of the largest.
    """
    if most < 2:
        return near
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / CHUNK)).cast("int")
    chunks = members.groupBy("head", "copies", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    left, right = (chunks.select(F.col("head").alias(x), F.col("part").alias(f"p{x}"), F.col("ids").alias(f"i{x}"), *["copies"][: x == "a"]) for x in ("a", "b"))
    met = near.join(left.drop("pa", "copies"), "a").join(right.drop("pb"), "b").select("ia", "ib", value, F.lit(False).alias("own"))
    within = left.where("copies > 1").join(right, F.col("a") == F.col("b")).where("pa <= pb").select("ia", "ib", F.lit(zero).alias(value), (F.col("pa") == F.col("pb")).alias("own"))
    met = met.unionByName(within)
    if most > CHUNK:
        met = met.repartition(4 * met.sparkSession.sparkContext.defaultParallelism)
    pairs = met.select(F.explode("ia").alias("x"), "ib", value, "own").select("x", F.explode("ib").alias("y"), value, "own").where("x != y and (x < y or not own)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), value)
