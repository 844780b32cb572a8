"""Row identity shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship

#: Identities of rows without doc_id lie below this, before those of all others.
NULL_IDS = -(2**62)


def identity() -> list[Column]:
    """``did, tkey`` of a row with doc_id and text, never null.

    did is the doc_id. Rows without one take 62 bits of a hash of their text,
    moved below ``NULL_IDS``: each text among them is a document of its own,
    before all others. tkey is another 64-bit hash of the text. So texts
    without doc_id are told apart by 126 bits, and texts that share a doc_id by
    64. (A doc_id below ``NULL_IDS`` keeps its place in the order of numbers.)
    """
    text = F.col("text").cast("string")
    own = F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 2) + F.lit(-(2**63))
    return [F.coalesce(F.col("doc_id").cast("long"), own).alias("did"), F.xxhash64(text).alias("tkey")]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` plus the non-null identity ``did, tkey`` for internal joins.

    Other columns are left behind, so none of theirs can clash. Rows with equal
    doc_id and text share an identity and so a result.
    """
    ship(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *identity())


def smallest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``key``, a hash from 0 to 2**63 - 1; ties go by the other columns.

    A plain sort with limit would send n rows of every partition to one place.
    So the distinct keys are estimated (to 5%), and only rows whose key lies in
    the lowest share that holds about 2 * n of them are sorted. Repeated rows
    have equal keys and count once; rows of one key must be equal.
    """
    share = min(1.0, 2.0 * n / max(1, rows.agg(F.approx_count_distinct(key)).first()[0]))
    low = rows.where(F.col(key) <= int(share * (2**63 - 1))) if share < 1 else rows
    return low.dropDuplicates([key]).orderBy(key, *[c for c in rows.columns if c != key]).limit(n)


#: A key with more than this share of all rows is joined by broadcast; there are fewer than 2048 of them.
HEAVY_SHARE = 2048


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows joined with keys, which has one row a key and in ``weight`` how many of rows have it.

    Keys above a 2048th of all that weight, fewer than 2048, are broadcast, so
    that none of them fills a task; the others meet their rows by a shuffle.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    return join_heavy(rows, keys, on, keys.where(F.col(weight) * HEAVY_SHARE > total).select(*on))


def join_heavy(rows: DataFrame, keys: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """rows joined with keys, those of heavy(on), which are few, by broadcast and the others by a shuffle."""
    if heavy.isEmpty():
        return rows.join(keys, on)
    own = keys.join(F.broadcast(heavy), on, "left_semi")
    light = rows.join(F.broadcast(heavy), on, "left_anti").join(keys, on)
    return rows.join(F.broadcast(own), on).unionByName(light)


def heavy_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """Keys that seem to have more than a 2048th of all rows, by every 64th row. They decide only how a join is carried out."""
    seen = materialize(rows.sample(1 / 64, seed=1).groupBy(*on).agg(F.count("*").alias("times")).where("times > 8"), "heavy")
    total = seen.agg(F.sum("times")).first()[0] or 0
    return seen.where(F.col("times") * HEAVY_SHARE > total).select(*on)
