"""Audio prints of three kinds, each kind clustered by its own measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import materialize
from . import bits, sequences
from .components import connected_components


def audio_clusters(prints: DataFrame, ber: float = fixed.AUDIO_BER, local: int = fixed.AUDIO_LOCAL_THRESHOLD, legacy: int = fixed.AUDIO_LEGACY_THRESHOLD) -> DataFrame:
    """id, tag, component of prints(id, print) that have a neighbour among the prints of their own kind.

    'cp:' prints are sequences, joined by their bit-error rate; equal ones are
    joined whatever they hold. 'lc:' prints and those without a tag are
    numbers, joined by differing bits. Kinds never meet. Null prints, unknown
    tags and numbers that are not hex have no neighbours.
    """
    tagged = materialize(bits.tagged_prints(prints.select(F.col("id").alias("path"), F.lower("print").alias("print")).where("print is not null")).withColumnRenamed("path", "id"), "prints")
    runs = tagged.where("tag = 'cp'")
    whole = runs.where(F.col("hex").rlike("^([0-9a-f]{8}){8,}$"))
    edges = [sequences.ber_pairs(whole.select("id", "tag", sequences.words32(F.col("hex")).alias("words")), ber).select(F.lit("cp").alias("tag"), "a", "b")]
    # Sequences too short to compare are joined to equal ones only.
    short = runs.join(whole.select("id"), "id", "left_anti")
    firsts = short.groupBy("hex").agg(F.min("id").alias("a"))
    edges.append(short.join(firsts, "hex").where("a <> id").select("tag", "a", F.col("id").alias("b")))
    for tag, threshold in (("lc", local), ("legacy", legacy)):
        numbers = tagged.where(F.col("tag") == tag).where(F.col("hex").rlike("^[0-9a-f]+$"))
        longest = numbers.agg(F.max(F.length("hex"))).first()[0]
        if longest is None:
            continue
        # Numbers of one width, in whole words: leading zeros change no distance.
        digits = -(-longest // 16) * 16
        words = numbers.select("id", bits.hex_words(F.lpad("hex", digits, "0")).alias("words"))
        edges.append(bits.hamming_pairs(words, threshold).select(F.lit(tag).alias("tag"), "a", "b"))
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    own = materialize(every.select(F.struct("tag", F.col("a").alias("id")).alias("a"), F.struct("tag", F.col("b").alias("id")).alias("b")), "audio")
    return connected_components(own).select("id.id", "id.tag", F.col("component.id").alias("component"))
