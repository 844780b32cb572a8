"""Sequences of 32-bit words: best bit-error rate over small shifts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import block_pairs, expanded
from .components import connected_components

SHIFTS, LEAST_WORDS = (0, 1, 2, -1, -2), 8


def words32(text: Column) -> Column:
    """Little-endian uint32 hex -> array<long>."""
    parts = F.regexp_extract_all(text, F.lit("[0-9A-Fa-f]{8}"), F.lit(0))
    return F.transform(parts, lambda w: F.conv(F.concat(F.substring(w, 7, 2), F.substring(w, 5, 2), F.substring(w, 3, 2), F.substring(w, 1, 2)), 16, 10).cast("long"))


def bit_error_rate(x: Column, y: Column) -> Column:
    """Least share of differing bits over the shifts that leave 8 words or more; 1.0 if none does."""
    rates = []
    for shift in SHIFTS:
        a = F.slice(x, F.lit(1 + max(shift, 0)), F.greatest(F.size(x) - max(shift, 0), F.lit(0)))
        b = F.slice(y, F.lit(1 + max(-shift, 0)), F.greatest(F.size(y) - max(-shift, 0), F.lit(0)))
        # The overlap is counted within the shorter of the two sequences.
        m = F.least(F.size(x), F.size(y)) - abs(shift)
        a, b = (F.slice(v, F.lit(1), F.greatest(m, F.lit(0))) for v in (a, b))
        bits = F.aggregate(F.zip_with(a, b, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda t, n: t + n)
        rates.append(F.when(m >= LEAST_WORDS, bits / (m * 32)).otherwise(1.0))
    return F.least(*rates)


def ber_pairs(prints: DataFrame, threshold: float) -> DataFrame:
    """a, b, ber of ids a < b within the threshold (below 1), for prints(id, tag, words) of one tag.

    Only distinct sequences meet, and only within a tag; copies are chained to
    the first of them, however short they are.
    """
    heads, count, _ = _heads(prints)
    return _near_heads(heads, count, threshold).unionByName(_members(prints, heads).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("ber")))


def all_ber_pairs(prints: DataFrame, threshold: float) -> DataFrame:
    """``ber_pairs`` with every copy in the pairs of its sequence, and with the pairs of copies among themselves; sequences too short to compare are left out."""
    prints = prints.where(F.size("words") >= LEAST_WORDS)
    heads, count, most = _heads(prints)
    return expanded(_near_heads(heads, count, threshold), _members(prints, heads), most, "ber", 0.0)


def _heads(prints: DataFrame) -> tuple[DataFrame, int, int]:
    """tag, words, id, copies of the distinct sequences, their number in the largest tag, and the copies of the most frequent."""
    heads = materialize(prints.where("id is not null and tag is not null and words is not null").groupBy("tag", "words").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "sequences")
    sizes = heads.groupBy("tag").agg(F.count("*").alias("n"), F.max("copies").alias("most")).agg(F.max("n"), F.max("most")).first()
    return heads, sizes[0] or 0, sizes[1] or 0


def _members(prints: DataFrame, heads: DataFrame) -> DataFrame:
    return prints.where("id is not null").join(heads.select("tag", "words", F.col("id").alias("head"), "copies"), ["tag", "words"]).select("head", "id", "copies")


#: Sequences of a block, and of the parts of two blocks that are multiplied at once.
BLOCK, ROWS, COLUMNS = 8192, 256, 1024


def _near_heads(heads: DataFrame, count: int, threshold: float) -> DataFrame:
    """a, b, ber between distinct sequences of one tag: every two of them meet, in blocks.

    No blocks of bits that are sure to agree are wide enough to select by. But
    the bits of the first words alone tell nearly all pairs apart, see
    ``candidates``; what is left is counted in full.
    """

    def near(x: pa.StructArray, y: pa.StructArray, own: bool) -> Iterator[pa.RecordBatch]:
        (ids, words), (other_ids, other_words) = x.flatten(), y.flatten()
        for a, b, ber in matches(words, other_words, own, threshold):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), other_ids.take(pa.array(b)), pa.array(ber)], names=["x", "y", "ber"])

    kind = heads.schema["id"].dataType.simpleString()
    # As 32 bits with a sign, to take half the room.
    halves = F.transform("words", lambda w: F.when(w > 2**31 - 1, w - 2**32).otherwise(w).cast("int"))
    met = block_pairs(heads.where(F.size("words") >= LEAST_WORDS).select("id", "tag", halves.alias("words")), count, BLOCK, near, f"x {kind}, y {kind}, ber double")
    return met.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ber")


class Sequences:
    """Sequences of one block, sorted by length: ``at`` their places, ``sizes``, the words padded with zeros, and ``known``, all ones where a word is not null."""

    def __init__(self, words: pa.ListArray):
        sizes = words.value_lengths().to_numpy(zero_copy_only=False)
        self.at = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.at].astype(np.int64)
        flat = words.flatten()
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(flat)) - np.repeat(starts, sizes)
        place = np.empty(len(sizes), np.int64)
        place[self.at] = np.arange(len(sizes))
        spot = np.repeat(place, sizes), inside
        self.words = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint32)
        self.words[spot] = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)
        self.known = None
        if flat.null_count:
            self.known = np.zeros_like(self.words)
            self.known[spot] = np.where(flat.is_valid().to_numpy(zero_copy_only=False), 0xFFFFFFFF, 0)

    def parts(self, most: int) -> Iterator[slice]:
        """Runs of sequences of about one length."""
        start = 0
        while start < len(self.sizes):
            stop = min(start + most, int(np.searchsorted(self.sizes, self.sizes[start] * 1.1 + 1, "right")))
            yield slice(start, stop)
            start = stop

    def signs(self, part: slice, first: int, count: int) -> np.ndarray:
        """1 and -1 for the bits of ``count`` words from ``first``, 0 for those of null words."""
        bits = lambda words: np.unpackbits(np.ascontiguousarray(words[part, first : first + count]).view(np.uint8), axis=1)
        out = bits(self.words).astype(np.float32)
        out *= 2
        out -= 1
        return out if self.known is None else out * bits(self.known)


def matches(words: pa.ListArray, others: pa.ListArray, own: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both, and the bit-error rate, of pairs within the threshold; with ``own`` both are one block, of which each pair is given once."""
    x = Sequences(words)
    y = x if own else Sequences(others)
    for columns in y.parts(COLUMNS):
        signs: dict[tuple[int, int], np.ndarray] = {}
        for rows in x.parts(ROWS):
            if own and rows.start >= columns.stop:
                break
            found = [counted(x, y, a, b, shift, threshold) for shift in SHIFTS for a, b in candidates(x, y, rows, columns, shift, threshold, own, signs)]
            found = [f for f in found if len(f[0])]
            if found:
                a, b, ber = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((ber, b, a))
                a, b, ber = a[order], b[order], ber[order]
                first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                yield x.at[a[first]], y.at[b[first]], ber[first]


def candidates(x: Sequences, y: Sequences, rows: slice, columns: slice, shift: int, threshold: float, own: bool, signs: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose first words alone do not differ by more bits than the whole overlap may.

    Sequences that have nothing in common differ by half of their bits, so
    2 * threshold of the overlap, and a little more, tells them apart.
    """
    least = int(min(x.sizes[rows.start], y.sizes[columns.start])) - abs(shift)
    most = int(min(x.sizes[rows.stop - 1], y.sizes[columns.stop - 1])) - abs(shift)
    if most < LEAST_WORDS:
        return
    used = max(1, min(least, math.ceil(2.4 * threshold * most) + 1))
    key = max(-shift, 0), used
    if key not in signs:
        if len(signs) > 2 * len(SHIFTS):
            signs.clear()
        signs[key] = y.signs(columns, *key)
    dot = x.signs(rows, max(shift, 0), used) @ signs[key].T
    floor = np.float32(32 * used - 2 * math.floor(threshold * 32 * most + 1e-9))
    if x.known is not None or y.known is not None:
        # A null word counts for no errors.
        lost = [0 if s.known is None else (s.known[part, first : first + used] == 0).sum(1) for s, part, first in ((x, rows, max(shift, 0)), (y, columns, key[0]))]
        floor = floor - 32 * np.add.outer(np.broadcast_to(lost[0], len(dot)), np.broadcast_to(lost[1], dot.shape[1])).astype(np.float32)
    (at,) = np.nonzero((dot >= floor).ravel())
    a, b = at // dot.shape[1] + rows.start, at % dot.shape[1] + columns.start
    if own:
        a, b = a[a < b], b[a < b]
    for start in range(0, len(a), 4096):
        yield a[start : start + 4096], b[start : start + 4096]


def counted(x: Sequences, y: Sequences, a: np.ndarray, b: np.ndarray, shift: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs that are within the threshold at this shift, and their rates."""
    m = np.minimum(x.sizes[a], y.sizes[b]) - abs(shift)
    a, b, m = a[m >= LEAST_WORDS], b[m >= LEAST_WORDS], m[m >= LEAST_WORDS]
    if not len(a):
        return a, b, m.astype(float)
    wide = int(m.max())
    i, j = slice(max(shift, 0), max(shift, 0) + wide), slice(max(-shift, 0), max(-shift, 0) + wide)
    inside = np.arange(wide) < m[:, None]

    def part(s: Sequences, values: np.ndarray, at: np.ndarray, span: slice) -> np.ndarray:
        out = values[at, span]
        return np.pad(out, ((0, 0), (0, wide - out.shape[1])))

    compared = np.where(inside, np.uint32(0xFFFFFFFF), np.uint32(0))
    for s, at, span in ((x, a, i), (y, b, j)):
        if s.known is not None:
            compared &= part(s, s.known, at, span)
    errors = np.bitwise_count((part(x, x.words, a, i) ^ part(y, y.words, b, j)) & compared).sum(1, dtype=np.int64)
    rate = errors / (m * 32)
    # Where no word is known on both sides there is no rate.
    near = (rate <= threshold) & compared.any(1)
    return a[near], b[near], rate[near]


def ber_clusters(prints: DataFrame, threshold: float) -> DataFrame:
    return connected_components(materialize(ber_pairs(prints, threshold).select("a", "b"), "ber"))
