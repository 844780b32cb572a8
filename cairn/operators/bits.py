"""Bit fingerprints: Hamming joins by pigeonhole patterns or block by block, clusters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import block_pairs, expanded, matrix
from .components import connected_components


#: No word of a print is missing.
WHOLE = "words is not null and not exists(words, w -> w is null)"


def hex_words(text: Column) -> Column:
    """Hex string -> array<long> of 64-bit words; null where it does not parse."""
    ok = text.rlike("^([0-9A-Fa-f]{16})+$")
    words = F.regexp_extract_all(text, F.lit("[0-9A-Fa-f]{16}"), F.lit(0))
    return F.when(ok, F.transform(words, lambda w: F.conv(w, 16, -10).cast("long")))


def hamming(x: Column, y: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, n: t + n)


def hamming_pairs(prints: DataFrame, threshold: int) -> DataFrame:
    """a, b, distance of ids a < b within the threshold, for prints(id, words) of equal width.

    Equal prints are collapsed first: pairs are between the first ids of
    different prints, and each further copy is linked to its first.
    """
    heads, count, _ = _heads(prints)
    return _near_heads(heads, count, threshold).unionByName(_members(prints, heads).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")))


def all_hamming_pairs(prints: DataFrame, threshold: int) -> DataFrame:
    """``hamming_pairs`` with every copy in the pairs of its print, and with the pairs of copies among themselves."""
    heads, count, most = _heads(prints)
    return expanded(_near_heads(heads, count, threshold), _members(prints, heads), most, "distance", 0)


def _heads(prints: DataFrame) -> tuple[DataFrame, int, int]:
    """words, id, copies of the distinct prints, their number, and the copies of the most frequent."""
    heads = materialize(prints.where(f"{WHOLE} and id is not null").groupBy("words").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "prints")
    sizes = heads.agg(F.count("*"), F.max("copies")).first()
    return heads, sizes[0], sizes[1] or 0


def _members(prints: DataFrame, heads: DataFrame) -> DataFrame:
    return prints.where("id is not null").join(heads.select("words", F.col("id").alias("head"), "copies"), "words").select("head", "id", "copies")


#: Seconds of one core for a pair of words in a block, for a posted pattern, and for two prints that meet in a pattern.
PAIR_S, POST_S, MEET_S = 2.5e-9, 1e-6, 2e-7
#: Prints of a block.
BLOCK = 32_768


def _near_heads(heads: DataFrame, count: int, threshold: int) -> DataFrame:
    """By patterns where these are selective enough for so many prints, else block by block."""
    width = heads.selectExpr("max(size(words)) AS w").first()["w"] or 1
    bounds, radii, seconds = _pieces(64 * width, threshold, count)
    return posted_pairs(heads, threshold, bounds, radii) if seconds < count * count / 2 * width * PAIR_S else compared_pairs(heads, count, threshold)


def compared_pairs(heads: DataFrame, count: int, threshold: int) -> DataFrame:
    """a, b, distance between distinct prints: every two are compared, in blocks."""

    def near(x: pa.StructArray, y: pa.StructArray, own: bool) -> Iterator[pa.RecordBatch]:
        (ids, words), (other_ids, other_words) = x.flatten(), y.flatten()
        words, others = (np.ascontiguousarray(matrix(w).view(np.uint64).T) for w in (words, other_words))
        found, held = [], 0

        def batch() -> pa.RecordBatch:
            a, b, away = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), other_ids.take(pa.array(b)), pa.array(away, pa.int32())], names=["x", "y", "distance"])

        for i in range(len(ids)):
            away = distances(words[:, i], others[:, i + 1 :] if own else others)
            (at,) = np.nonzero(away <= threshold)
            if len(at):
                found.append((np.full(len(at), i), at + (i + 1 if own else 0), away[at]))
                held += len(at)
            if held > 50_000:
                yield batch()
                found, held = [], 0
        if found:
            yield batch()

    kind = heads.schema["id"].dataType.simpleString()
    met = block_pairs(heads.select("id", F.size("words").alias("tag"), "words"), count, BLOCK, near, f"x {kind}, y {kind}, distance int")
    return met.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def distances(print_: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Differing bits of one print, a word a row, and each of others."""
    out = np.bitwise_count(others[0] ^ print_[0])
    if len(print_) > 1:
        out = out.astype(np.uint32)
        for word, column in zip(print_[1:], others[1:], strict=True):
            out += np.bitwise_count(column ^ word)
    return out


def posted_pairs(heads: DataFrame, threshold: int, bounds: list[int], radii: tuple[int, int]) -> DataFrame:
    """a, b, distance between distinct prints, by patterns.

    The bits are cut into m pieces: two prints within the threshold differ by
    threshold / m bits at most in one of them. A piece is compared not with the
    other's piece but with all patterns near it: one side posts those within
    half of that radius, the other those within the other half, and the two
    meet in one pattern.
    """
    sides = [heads.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"), F.explode(_patterns(bounds, radius)).alias("key")) for x, radius in zip(("a", "b"), radii, strict=True)]
    # The patterns are many times the table that Spark sees below them, so it may not broadcast them.
    met = sides[0].join(sides[1].hint("merge"), "key").where(F.col("a") < F.col("b"))
    return met.select("a", "b", hamming(F.col("wa"), F.col("wb")).alias("distance")).where(F.col("distance") <= threshold).distinct()


def _pieces(size: int, threshold: int, count: int) -> tuple[list[int], tuple[int, int], float]:
    """Bounds of the pieces, the radius of the patterns that each side posts, and about how many seconds of a core that takes.

    m is chosen among pieces of 16 to 24 bits for the least work on so many
    prints whose bits are even.
    """

    def cost(m: int) -> float:
        radius, wide = threshold // m, size // m
        posts = m * sum(comb(wide + 1, k) for r in (radius - radius // 2, radius // 2) for k in range(r + 1))
        meet = m * sum(comb(wide, k) * comb(k, k // 2) for k in range(radius + 1)) / 2**wide
        return count * posts * POST_S + count * count / 2 * meet * MEET_S

    m = min(range(-(-size // 24), size // 16 + 1), key=lambda m: (cost(m), m))
    radius = threshold // m
    return [size * i // m for i in range(m + 1)], (radius - radius // 2, radius // 2), cost(m)


def extremes(prints: DataFrame) -> DataFrame:
    """One row: max_intra, the largest distance of two ids of one label, and min_inter, the least of two labels, for prints(id, words, label) of equal width.

    All pairs count. Prints of one content and label are collapsed; what is
    left is compared in blocks, of which each gives one row.
    """
    heads = prints.where(f"{WHOLE} and label is not null and id is not null").groupBy("words", "label").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    heads = materialize(heads.withColumn("code", F.xxhash64("label")), "labelled")
    count = heads.count()

    def compare(x: pa.StructArray, y: pa.StructArray, own: bool) -> Iterator[pa.RecordBatch]:
        intra, inter = -1, 1 << 30
        (ids, last, codes, words), (other_ids, other_last, other_codes, other_words) = x.flatten(), y.flatten()
        codes, order = codes.to_numpy(), np.argsort(other_codes.to_numpy(), kind="stable")
        words, others = (np.ascontiguousarray(matrix(w).view(np.uint64).T) for w in (words, other_words))
        others, other_codes = np.ascontiguousarray(others[:, order]), other_codes.to_numpy()[order]
        # Rows of one id only, for a pair needs two: in this order, by their ids.
        single = {}
        for at, (first, end) in enumerate(zip(other_ids.take(pa.array(order)).to_pylist(), other_last.take(pa.array(order)).to_pylist(), strict=True)):
            if first == end:
                single.setdefault(first, []).append(at)
        starts, ends = np.searchsorted(other_codes, codes, "left"), np.searchsorted(other_codes, codes, "right")
        for i, (first, end) in enumerate(zip(ids.to_pylist(), last.to_pylist(), strict=True)):
            away = distances(words[:, i], others).astype(np.int32)
            alike, apart = away, away
            if first == end and first in single:
                alike, apart = away.copy(), away.copy()
                alike[single[first]], apart[single[first]] = -1, 1 << 30
            start, stop = starts[i], ends[i]
            intra = max(intra, alike[start:stop].max(initial=-1))
            inter = min(inter, apart[:start].min(initial=1 << 30), apart[stop:].min(initial=1 << 30))
        yield pa.RecordBatch.from_arrays([pa.array([int(intra)], pa.int32()), pa.array([int(inter)], pa.int32())], names=["intra", "inter"])

    found = block_pairs(heads.select("id", F.size("words").alias("tag"), "last", "code", "words"), count, BLOCK, compare, "intra int, inter int")
    return found.agg(F.max(F.when(F.col("intra") >= 0, F.col("intra"))).alias("max_intra"), F.min(F.when(F.col("inter") < 1 << 30, F.col("inter"))).alias("min_inter"))


def _patterns(bounds: list[int], radius: int) -> Column:
    """Hashes of (piece, pattern) for all patterns within the radius of each piece of ``words``."""
    out = []
    for piece, (start, stop) in enumerate(zip(bounds, bounds[1:], strict=False)):
        masks = [sum(1 << i for i in flips) for k in range(radius + 1) for flips in combinations(range(stop - start), k)]
        out.append(_near(piece, _bits("words", start, stop), masks))
    return F.flatten(F.array(*out))


def _near(piece: int, value: Column, masks: list[int]) -> Column:
    return F.transform(F.expr(f"array({', '.join(f'{x}L' for x in masks)})"), lambda x: F.xxhash64(F.lit(piece), value.bitwiseXOR(x)))


def _bits(words: str, start: int, stop: int) -> Column:
    """The bits [start, stop) of an array of words, fewer than 64, as one number."""
    out = None
    for w in range(start // 64, (stop - 1) // 64 + 1):
        low, high = max(start - 64 * w, 0), min(stop - 64 * w, 64)
        part = F.shiftrightunsigned(F.get(F.col(words), w), low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        part = F.shiftleft(part, 64 * w + low - start)
        out = part if out is None else out.bitwiseOR(part)
    return out


def clusters(prints: DataFrame, threshold: int) -> DataFrame:
    """id, component; ids with no neighbour are left out."""
    return connected_components(materialize(hamming_pairs(prints, threshold).select("a", "b"), "hamming"))


def tagged_prints(files: DataFrame) -> DataFrame:
    """path, tag, words from files(path, print) with 'cp:' or 'lc:' before the hex; untagged prints are legacy."""
    tag = F.when(F.col("print").startswith("cp:"), "cp").when(F.col("print").startswith("lc:"), "lc").otherwise("legacy")
    body = F.when(tag == "legacy", F.lpad("print", F.greatest(F.length("print"), F.lit(16)), F.lit("0"))).otherwise(F.expr("substring(print, 4)"))
    return files.select("path", tag.alias("tag"), body.alias("hex"))
