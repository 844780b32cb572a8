"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items are normalised to words; their windows of ``window`` words are the
patterns. Each document is normalised the same way and scanned once; a hit is
reported by word range and mapped back to byte offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, ship
from .rows import keyed
from .textkernel import byte_set

WINDOW = 10
#: Bytes of patterns in one automaton (about 60 bytes of memory each); more of them are scanned in blocks of about this size.
BLOCK_CHARS = 2_000_000

#: Bytes that separate words: ASCII other than digits and letters. Bytes from 0x80 on belong to words.
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
FOLD = bytes(32 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SEPARATOR = byte_set(SEPARATORS)


def normal_words(text: str) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def padded_windows(text: str, window: int) -> Iterator[bytes]:
    """The windows of an item, in blanks. A shorter item, but not an empty one, is one window."""
    words = normal_words(text)
    for i in range(max(1, len(words) - window + 1) if words else 0):
        yield b" ".join([b"", *words[i : i + window], b""])


#: Windows of an Arrow batch, whatever the length of the items.
WINDOWS_OF_BATCH = 10_000


def item_patterns(benchmark: DataFrame, window: int) -> DataFrame:
    """``pattern, ids``: each distinct window of the items and the sorted ids, as strings, of those that hold it."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((p, item) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in padded_windows(text, window))
            while part := list(islice(pairs, WINDOWS_OF_BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.binary()), pa.array([i for _, i in part], pa.string())], names=["pattern", "item"])

    held = items.mapInArrow(cut, "pattern binary, item string").distinct()
    return held.groupBy("pattern").agg(F.array_sort(F.collect_list("item")).alias("ids"))


@lru_cache(maxsize=2)
def automaton(patterns: tuple[tuple[bytes, tuple[str, ...]], ...]):
    """Built once in each Python worker. None without patterns."""
    import ahocorasick

    if not patterns:
        return None
    built = ahocorasick.Automaton()
    for raw, ids in patterns:
        pattern = raw.decode("latin-1")
        built.add_word(pattern, (len(pattern), pattern.count(" ") - 1, ids))
    built.make_automaton()
    return built


def scan_text(built, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
    """Words of the text, merged hits (first word, word after, first byte, byte after), ids of the items hit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(FOLD).split()
    if built is None or not words:
        return len(words), [], []
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    spans: list[list[int]] = []
    items: set[str] = set()
    hits = list(built.iter(line))
    if not hits:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    for end, (length, count, ids) in hits:
        first = int(np.searchsorted(blanks, end - length + 1))
        items.update(ids)
        spans.append([first, first + count])
    spans.sort()
    merged = [spans[0]]
    for a, b in spans[1:]:
        if a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    inside = ~IS_SEPARATOR[np.frombuffer(raw, np.uint8)]
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return len(words), [(a, b, int(start[a]), int(stop[b - 1])) for a, b in merged], sorted(items)


SPAN = "struct<first_word:long,last_word:long,first_byte:long,last_byte:long>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, did, tkey, n_words, spans, items`` for each row of docs(doc_id, text).

    benchmark(item_id, text) is the query set. spans are the merged stretches
    of words inside an occurrence of an item's window, ends excluded, with
    their byte offsets in the original text; items are the ids of the items
    that have such windows, sorted as strings.

    A null or empty text has no words and no hits. An item without id, text or
    words has no windows; of repeated items each id counts once. A null doc_id
    is an ordinary document; repeated rows have equal results. Empty tables on
    either side are fine. Other columns are ignored. The windows of the query
    set are made and grouped by the executors. They are dealt by hash into
    blocks of about ``block_chars`` bytes, and the driver reads one block at a
    time and sends it to the workers as an automaton. If there are several, the
    documents are scanned once for each and the hits are merged.
    """
    ship(docs.sparkSession)
    patterns = materialize(item_patterns(benchmark, window), "patterns")
    blocks = max(1, -(-(patterns.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) // block_chars))
    rows = keyed(docs).select("doc_id", "did", "tkey", "text")
    schema = f"doc_id long, did long, tkey long, n_words long, spans array<{SPAN}>, items array<string>"

    def scan(block: int) -> DataFrame:
        own = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block) if blocks > 1 else patterns
        words = tuple(sorted((bytes(r[0]), tuple(r[1])) for r in own.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = automaton(words)
            for batch in batches:
                found = [scan_text(built, text) for text in batch.column(3).to_pylist()]
                spans = [[dict(zip(("first_word", "last_word", "first_byte", "last_byte"), x, strict=True)) for x in f[1]] for f in found]
                kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "last_word", "first_byte", "last_byte")]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([f[0] for f in found], pa.int64()), pa.array(spans, kind), pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["doc_id", "did", "tkey", "n_words", "spans", "items"])

        return rows.mapInArrow(run, schema)

    first = scan(0)
    if blocks == 1:
        release(patterns)
        return first
    first = materialize(first, "block")
    # The hits of the other blocks, once for each distinct row.
    others = [materialize(scan(b).where(F.size("spans") > 0).select("did", "tkey", "spans", "items").dropDuplicates(["did", "tkey"]), "block") for b in range(1, blocks)]
    more = reduce(DataFrame.unionByName, others).groupBy("did", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans2"), F.flatten(F.collect_list("items")).alias("items2"))
    joined = first.join(more, ["did", "tkey"], "left").withColumn("all", F.when(F.col("spans2").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "spans2"))))
    items = F.when(F.col("items2").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "items2"))))
    return joined.select("doc_id", "did", "tkey", "n_words", F.when(F.col("spans2").isNull(), F.col("spans")).otherwise(merge_spans("all")).alias("spans"), items.alias("items"))


def merge_spans(name: str):
    """Sorted spans, joined where they touch."""
    empty = F.array().cast(f"array<{SPAN}>")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["first_word"].alias("first_word"), F.greatest(last["last_word"], x["last_word"]).alias("last_word"), last["first_byte"].alias("first_byte"), F.greatest(last["last_byte"], x["last_byte"]).alias("last_byte"))
        return F.when(F.size(done) == 0, F.array(x)).when(x["first_word"] <= last["last_word"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.col(name), empty, add)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["last_word"] - x["first_word"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


#: Windows as padded strings: a document holds a window if its padded, normalised text contains it.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS n FROM windows),
places AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (p)),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
