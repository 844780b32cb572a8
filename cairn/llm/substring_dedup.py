"""Substring dedup by relative Lempel-Ziv parsing over words.

``repeats.py`` finds which stretches of a document can hold a window that also
starts elsewhere, drops those whose whole content stands earlier, and deals the
others, as phrases, into reference blocks. Each block is indexed by a suffix
array, and each of its phrases is parsed greedily against all that stands before
it in the corpus: the next factor is the longest string there that the phrase
goes on with. Factors of a window or more are duplicate spans. A window that
begins in one factor and ends in another may yet stand earlier as a whole, so
those at factor boundaries are looked up in the index singly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import BLOCK_PHRASES, MOST_KINDS, Phrases, Shape, cut_spans, repeated_spans, suffix_ranks, word_symbols, word_values
from .rows import keyed

WINDOW, GRAM = 20, 8


class Reference:
    """Suffix array of phrases in corpus order; ``longest[i]``: symbols from i on that also start at some place before i."""

    def __init__(self, phrases: Phrases):
        sizes = np.diff(phrases.bounds)
        # Each phrase ends in a separator of its own, so no match leaves a phrase.
        self.at = np.arange(len(phrases.codes)) + np.repeat(np.arange(len(sizes)), sizes)
        text = np.empty(len(phrases.codes) + len(sizes), np.int64)
        text[self.at] = phrases.codes
        text[phrases.bounds[1:] + np.arange(len(sizes))] = phrases.codes.max(initial=0) + 1 + np.arange(len(sizes))
        self.levels = suffix_ranks(text, int(sizes.max(initial=0)) + 1)
        self.order = np.argsort(self.levels[-1])
        before, after = self._neighbours()
        self.longest = np.maximum(self._common(before), self._common(after))[self.at]

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position the nearest ones before and after it in the suffix order that stand earlier in the text; -1 for none.

        The longest earlier match of a suffix is with one of these two.
        """
        n = len(self.order)
        found = np.full((2, n), -1, np.int64)
        for side, order in enumerate((self.order.tolist(), self.order[::-1].tolist())):
            stack: list[int] = []
            best = [-1] * n
            for i in order:
                while stack and stack[-1] > i:
                    stack.pop()
                if stack:
                    best[i] = stack[-1]
                stack.append(i)
            found[side] = best
        return found[0], found[1]

    def _common(self, other: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each suffix with that at ``other``."""
        length = np.zeros(len(other), np.int64)
        here = np.arange(len(other))
        known = other >= 0
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = here + length, other + length
            inside = known & (np.maximum(i, j) < len(other))
            same = inside.copy()
            same[inside] = self.levels[k][i[inside]] == self.levels[k][j[inside]]
            length += same * (1 << k)
        return length


def factors(longest: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the factors of a greedy parse; a symbol that stands nowhere before is a factor of its own. All phrases advance together."""
    cursor, end = bounds[:-1].copy(), bounds[1:]
    starts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = np.flatnonzero(cursor < end)
    while len(live):
        step = np.maximum(1, longest[cursor[live]])
        starts.append(cursor[live])
        lengths.append(step)
        cursor[live] += step
        live = live[cursor[live] < end[live]]
    return np.concatenate(starts), np.concatenate(lengths)


def parse(phrases: Phrases, least: int) -> np.ndarray:
    """For each code of the phrases whether a window of ``least`` symbols starts there that also starts before."""
    reference = Reference(phrases)
    start, length = factors(reference.longest, phrases.bounds)
    hit = np.zeros(len(phrases.codes) + 1, np.int64)
    # Windows inside a factor are repeated as the factor is.
    long = length >= least
    np.add.at(hit, start[long], 1)
    np.add.at(hit, start[long] + length[long] - least + 1, -1)
    hit = np.cumsum(hit)[:-1] > 0
    # Those that cross its end are looked up.
    first = start + np.maximum(0, length - least + 1)
    n = start + length - first
    crossing = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    hit[crossing] |= reference.longest[crossing] >= least
    return hit


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_phrases: int = BLOCK_PHRASES, most_kinds: int = MOST_KINDS) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` for each row of docs(doc_id, text).

    Words are maximal runs outside blanks (space, tab to carriage return). A
    word is removed if a window of ``window`` words covers it whose words also
    start earlier: in a smaller doc_id, or earlier in the same document.
    Windows are judged on the input. spans are removed word ranges (start,
    stop); kept is the text of the other words, joined by one space.

    Null or empty text: no words, nothing removed, empty kept. Fewer words than
    a window: nothing removed. Repeated rows (same doc_id and text) are one
    place and get equal results. Rows without doc_id come before all others,
    each text a document of its own. An empty table gives an empty table. Other
    columns are ignored. ``block_phrases`` and ``most_kinds`` bound what one
    task indexes; an anchor with more contents is compared by window hashes.
    """
    rows, shape = keyed(docs), Shape(word_symbols, word_values, parse, window, min(gram, window))
    cut = cut_spans(rows, repeated_spans(rows, shape, np.uint64, True, block_phrases, most_kinds), shape, b" ")
    return cut.select("doc_id", F.col("n").alias("n_words"), "n_removed", "spans", F.col("kept").cast("string").alias("kept"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE n > 1),
places AS (SELECT doc_id, w[j] AS x, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM words)),
cut AS (
  SELECT doc_id, count(gone.j) AS n, string_agg(x, ' ' ORDER BY j) FILTER (gone.j IS NULL) AS kept
  FROM places LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""
