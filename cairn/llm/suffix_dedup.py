"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

``repeats.py`` finds which stretches of a text can hold a string that also
starts elsewhere and deals them, as phrases, into blocks; in a phrase the long
gram that all of its kind share is one symbol. The phrases of a block form
shards, each with a transform of its own. Their transforms are merged by
refining the interleave of their rows: a pass moves every row to where its
suffix, longer by one symbol, belongs, so that after h passes the rows are in
order of their first h symbols, and rows that a pass parts have h - 1 symbols in
common. No suffixes are sorted again. Rows that no pass up to the length of a
string has parted are the repeated intervals.

A pass for each of 400 bytes would be too many over whole texts (measured, see
README). In phrases a string has 101 symbols.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import BLOCK_PHRASES, MOST_KINDS, Phrases, Shape, byte_symbols, byte_values, cut_spans, repeated_spans, suffix_ranks
from .rows import keyed

LENGTH, GRAM = 400, 300
#: Phrases of a shard.
SHARD_PHRASES = 512


class Transform:
    """Burrows-Wheeler transform of some phrases: ``last[p]`` stands before the p-th suffix, which starts at code ``at[p]``.

    Each phrase ends in a mark of its own, below all codes, the marks in order
    of the phrases: their suffixes are the first rows. The suffix that is a
    whole phrase has 0 before it. A mark is at -1.
    """

    def __init__(self, phrases: Phrases, first: int, stop: int):
        low, high = phrases.bounds[first], phrases.bounds[stop]
        sizes = np.diff(phrases.bounds[first : stop + 1])
        self.phrases = stop - first
        place = np.arange(high - low) + np.repeat(np.arange(self.phrases), sizes)
        text, where = np.empty(high - low + self.phrases, np.int64), np.full(high - low + self.phrases, -1, np.int64)
        text[place], where[place] = phrases.codes[low:high] + self.phrases, np.arange(low, high)
        marks = np.cumsum(sizes) + np.arange(self.phrases)
        text[marks] = np.arange(self.phrases)
        order = np.argsort(suffix_ranks(text, int(sizes.max()) + 1)[-1])
        before = np.where(text < self.phrases, 0, text - self.phrases)
        self.last = before[order - 1].astype(np.uint16 if phrases.codes.max() < 1 << 16 else np.int64)
        self.at = where[order]


def merge(shards: list[Transform], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes where the rows of the merged transform start, and what each has in common with the row before, up to ``most``."""
    rows = [len(s.last) for s in shards]
    marks = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.phrases for s in shards])
    side = np.repeat(np.arange(len(shards), dtype=np.uint8), rows)
    total, fixed = len(side), len(marks)
    interval = np.zeros(total, np.int32)
    common = np.full(total, most, np.int32)
    last = np.empty(total, shards[0].last.dtype)
    parted = np.zeros(total, bool)
    for h in range(1, most + 1):
        for k, s in enumerate(shards):
            last[side == k] = s.last
        rest = np.flatnonzero(last)
        order = rest[np.argsort(last[rest], kind="stable")]
        symbol, inside = last[order], interval[order]
        moved = np.concatenate((marks, side[order]))
        now = np.ones(total, bool)
        now[fixed + 1 :] = (symbol[1:] != symbol[:-1]) | (inside[1:] != inside[:-1])
        common[now & ~parted] = h - 1
        settled = np.array_equal(now, parted) and np.array_equal(moved, side)
        side, parted, interval = moved, now, np.cumsum(now, dtype=np.int32)
        if settled:
            break
    at = np.empty(total, np.int64)
    for k, s in enumerate(shards):
        at[side == k] = s.at
    return at, common


def repeated_windows(phrases: Phrases, least: int) -> np.ndarray:
    """For each code of the phrases whether a string of ``least`` symbols starts there that also starts elsewhere."""
    edges = [*range(0, len(phrases.n), max(SHARD_PHRASES, -(-len(phrases.n) // 255))), len(phrases.n)]
    at, common = merge([Transform(phrases, i, j) for i, j in zip(edges, edges[1:], strict=False)], least)
    joined = common >= least
    repeated = at[joined | np.append(joined[1:], False)]
    hit = np.zeros(len(phrases.codes), bool)
    hit[repeated[repeated >= 0]] = True
    return hit


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_phrases: int = BLOCK_PHRASES, most_kinds: int = MOST_KINDS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept`` for each row of docs(doc_id, text).

    A byte of the UTF-8 text is removed if a string of ``length`` bytes covers
    it that also starts anywhere else, in this document or another. Strings are
    judged on the input and never cross documents. spans are removed byte
    ranges; kept holds the bytes left, which need not be valid UTF-8.

    Null text: empty. Texts below ``length``: nothing removed. Repeated rows
    are places of their own, so their long strings go. A null doc_id is an
    ordinary document. An empty table gives an empty table. Other columns are
    ignored. ``block_phrases`` and ``most_kinds`` bound what one task merges; an
    anchor with more contents is compared by hashes of its strings.
    """
    rows, shape = keyed(docs), Shape(byte_symbols, byte_values, repeated_windows, length, min(gram, length))
    cut = cut_spans(rows, repeated_spans(rows, shape, np.uint8, False, block_phrases, most_kinds), shape, None)
    return cut.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "spans", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Repeated starts within 400 bytes of each other are one removed run; what lies between the runs is kept.
ORACLE = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h
  FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM docs WHERE n >= 400)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS times FROM starts) WHERE times > 1),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS new FROM repeated),
numbered AS (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY doc_id, run),
total AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
ends AS (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, n + 1, n + 1 FROM docs),
pieces AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 1) AS low, a AS high FROM ends),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN high > low THEN hex(array_slice(b, low, high - 1)) ELSE '' END, '' ORDER BY low, high) AS h
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
