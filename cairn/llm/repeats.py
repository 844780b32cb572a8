"""Repeated windows of symbols (bytes or words) across a whole corpus.

Comparing every window with every other would shuffle one row a symbol. Three
levels shrink that, without losing a window:

1. *Anchors.* Each window of ``window`` symbols picks the smallest hash among
   the grams of ``gram`` symbols inside it. Equal windows pick the same gram at
   the same offset, so a window whose anchor occurs once in the corpus is
   unique. Neighbouring windows mostly share an anchor: they form a *run*.
2. *Runs.* Runs whose whole covered content is equal (96-bit hash) have equal
   windows throughout. One run of each such class, the first in the corpus,
   stands for the class: it is the indexed reference.
3. *Borders.* Where runs share an anchor but not their content, a repeated
   stretch begins or ends. One run of each content becomes a *phrase*: its
   symbols, with the anchor's gram, which all of them share, as one symbol.
   Phrases are dealt by anchor into blocks of bounded size, and each block is
   compared by the operator's own method (``Shape.compare``).

An anchor with more contents than a block holds would fill one task. Its windows
are counted singly, by hash, which spreads them over all tasks.

Every comparison is a hash-partitioned aggregate or equi-join; keys heavy enough
to fill a task are few by their number and broadcast (``join_keys``), so no task
holds all members of a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .rows import join_keys
from .textkernel import MAX, Block, as_long, base, blocks, mix, word_hashes, words

#: Phrases of a block on average, and contents of an anchor up to which it is part of a block.
BLOCK_PHRASES, MOST_KINDS = 1024, 1024
#: shape packs two small numbers: windows of the run, and symbols before its anchor (times 65536).
RUN_SCHEMA = "did long, tkey long, anchor long, k1 long, k2 int, pos int, shape int"
PHRASE_SCHEMA = "block long, anchor long, did long, tkey long, pos int, shape int, symbols binary"
SPAN_SCHEMA = "did long, tkey long, pos int, len int"


def byte_symbols(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two symbol hashes for each byte, and the bounds of each row."""
    return base(1).table[block.data], base(2).table[block.data], block.offsets


def byte_values(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return block.data, block.offsets


def word_values(block: Block) -> tuple[np.ndarray, np.ndarray]:
    found = words(block)
    return word_hashes(block, found, 1), found.first


def word_symbols(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two symbol hashes for each word, and the bounds of each row."""
    found = words(block)
    return word_hashes(block, found, 1), word_hashes(block, found, 2), found.first


@dataclass(frozen=True)
class Shape:
    """What counts as a repeat: ``window`` symbols, found by grams of ``gram``.

    ``raw`` gives the symbols of a block as numpy values (bytes, or hashes of
    words). ``compare`` tells which windows of a block of phrases count, see
    ``Phrases``.
    """

    symbols: Callable
    raw: Callable
    compare: Callable
    window: int
    gram: int

    def __post_init__(self):
        if not 0 < self.gram <= self.window < 1 << 15:
            raise ValueError("needs 0 < gram <= window < 32768")

    @property
    def least(self) -> int:
        """Symbols of a window in a phrase, where the gram is one."""
        return self.window - self.gram + 1

    def runs(self, block: Block) -> tuple[np.ndarray, ...]:
        """row, anchor, k1, k2, pos and shape of each run; pos counts from its row's start."""
        s1, s2, bounds = self.symbols(block)
        size, w = len(s1), self.window - self.gram + 1
        if size < self.window:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        f1, f2 = base(3), base(4)
        p1 = f1.sums(s1)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        m = size - self.gram + 1
        grams = mix_slices(f1, p1, self.gram)
        packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        packed[np.arange(m) + self.gram > ends[:m]] = MAX
        least = sliding_min(packed, w)
        valid = np.flatnonzero(np.arange(len(least)) + self.window <= ends[: len(least)])
        if not len(valid):
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        at = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        start, n = valid[new], np.diff(np.append(new, len(at)))
        stop = start + n - 1 + self.window
        row = np.searchsorted(bounds, start, "right") - 1
        return row, grams[at[new]], f1.ranges(p1, start, stop), f2.ranges(f2.sums(s2), start, stop), start - bounds[row], n + ((at[new] - start) << 16)


@dataclass
class Phrases:
    """Distinct phrases in corpus order. ``codes`` are their symbols as numbers from 1, phrase r at ``bounds[r]``..``bounds[r + 1]``.

    Code i stands for the i-th symbol of its run up to the gram, which is one
    code; so the first ``n`` codes of a phrase are where its windows start.
    """

    did: np.ndarray
    tkey: np.ndarray
    pos: np.ndarray
    n: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, kind: type) -> Phrases:
        did, tkey, pos, shape, anchor = (table.column(c).to_numpy() for c in ("did", "tkey", "pos", "shape", "anchor"))
        order = np.lexsort((pos, tkey, did))
        same = (did[order][1:] == did[order][:-1]) & (tkey[order][1:] == tkey[order][:-1]) & (pos[order][1:] == pos[order][:-1])
        order = order[np.append(True, ~same)[: len(order)]]  # Rows that repeat a document bring its phrases again.
        raw = table.column("symbols").to_pylist()
        parts = [np.frombuffer(raw[i], kind) for i in order]
        bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
        values, coded = np.unique(np.concatenate([*parts, np.zeros(0, kind)]), return_inverse=True)
        codes = np.zeros(bounds[-1], np.int64)
        grams = bounds[:-1] + (shape[order] >> 16)
        codes[grams] = np.unique(anchor[order], return_inverse=True)[1] + len(values) + 1
        codes[codes == 0] = coded + 1
        return cls(did[order], tkey[order], pos[order], shape[order] & 0xFFFF, codes, bounds)

    def spans(self, hit: np.ndarray, window: int) -> pa.Table:
        """Stretches covered by the windows that start at codes with ``hit``."""
        fence = np.zeros(len(hit), bool)
        fence[self.bounds[:-1]] = True
        first = np.flatnonzero(hit & (fence | ~np.append(False, hit[:-1])))
        last = np.flatnonzero(hit & np.append(fence[1:] | ~hit[1:], True))
        row = np.searchsorted(self.bounds, first, "right") - 1
        pos = self.pos[row] + first - self.bounds[row]
        return pa.table({"did": self.did[row], "tkey": self.tkey[row], "pos": pos.astype(np.int32), "len": (last - first + window).astype(np.int32)})


def suffix_ranks(text: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of all suffixes of text by their first 1, 2, 4, ... symbols, up to ``longest`` or more."""
    levels, k = [np.unique(text, return_inverse=True)[1]], 1
    while k < longest:
        ahead = np.zeros(len(text), np.int64)
        ahead[:-k] = levels[-1][k:] + 1
        levels.append(np.unique(levels[-1] * np.int64(len(text) + 1) + ahead, return_inverse=True)[1])
        k *= 2
    return levels


def mix_slices(family, sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of every range of ``length`` symbols."""
    return mix((sums[length:] - sums[:-length]) * family.powers(len(sums) - length)[1] + np.uint64(length))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: block-wise running minima from both sides."""
    if w == 1:
        return x
    size = -(-len(x) // w) * w
    padded = np.full(size, MAX, np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(x) - w + 1
    return np.minimum(back[:count], ahead[w - 1 : w - 1 + count])


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32), pa.int32())


def _low(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint32).view(np.int32), pa.int32())


def run_rows(docs: DataFrame, shape: Shape) -> DataFrame:
    """One row for each run of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for block in blocks(batch.column(2)):
                row, anchor, k1, k2, pos, packed = shape.runs(block)
                if len(row):
                    row = row + block.first
                    yield pa.RecordBatch.from_arrays([pa.array(did[row]), pa.array(tkey[row]), as_long(anchor), as_long(k1), _low(k2), _int(pos), _int(packed)], names=["did", "tkey", "anchor", "k1", "k2", "pos", "shape"])

    return docs.select("did", "tkey", "text").mapInArrow(scan, RUN_SCHEMA)


def phrase_rows(docs: DataFrame, shape: Shape) -> DataFrame:
    """The phrases of documents that carry ``runs`` array<struct<pos,shape,anchor,block>>."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for block in blocks(batch.column(2)):
                values, bounds = shape.raw(block)
                part = batch.column(3).slice(block.first, block.last - block.first)
                counts = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                pos, packed, anchor, dealt = (part.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.arange(len(counts)), counts)
                start = bounds[row] + pos
                gram = start + (packed >> 16)
                stop = start + (packed & 0xFFFF) + shape.window - 1
                found = [values[i:g].tobytes() + values[g + shape.gram : j].tobytes() for i, g, j in zip(start.tolist(), gram.tolist(), stop.tolist(), strict=True)]
                row = row + block.first
                yield pa.RecordBatch.from_arrays([pa.array(dealt), pa.array(anchor), pa.array(did[row]), pa.array(tkey[row]), _int(pos), _int(packed), pa.array(found, pa.binary())], names=["block", "anchor", "did", "tkey", "pos", "shape", "symbols"])

    return docs.select("did", "tkey", "text", "runs").mapInArrow(scan, PHRASE_SCHEMA)


def window_rows(phrases: DataFrame, shape: Shape, kind: type) -> DataFrame:
    """Hashes of the single windows of phrases, over their anchor, the symbols before it and those after it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(0, len(table), BLOCK_PHRASES):
                part = table.slice(i, BLOCK_PHRASES)
                raw = [np.frombuffer(x, kind) for x in part.column("symbols").to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
                # Codes from the values alone, so that they agree in all tasks.
                symbols = mix(np.concatenate(raw).astype(np.uint64) + np.uint64(1))
                did, tkey, pos, packed, anchor = (part.column(c).to_numpy() for c in ("did", "tkey", "pos", "shape", "anchor"))
                n, before = packed & 0xFFFF, packed >> 16
                row, skip = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
                offset = np.arange(len(row)) - skip
                start, length = bounds[row] + offset, shape.least - 1
                # A window is told by its anchor, where that lies, and the symbols around it.
                seed = anchor.view(np.uint64)[row] + (before[row] - offset).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                w1, w2 = (mix(seed ^ f.ranges(f.sums(symbols), start, start + length)) for f in (base(3), base(4)))
                yield pa.RecordBatch.from_arrays([pa.array(did[row]), pa.array(tkey[row]), _int(pos[row] + offset), as_long(w1), _low(w2)], names=["did", "tkey", "pos", "w1", "w2"])

    return phrases.select("did", "tkey", "pos", "shape", "anchor", "symbols").mapInArrow(scan, "did long, tkey long, pos int, w1 long, w2 int")


def repeated_spans(docs: DataFrame, shape: Shape, kind: type, keep_first: bool, block_phrases: int = BLOCK_PHRASES, most_kinds: int = MOST_KINDS) -> DataFrame:
    """``did, tkey, pos, len``: stretches of symbols covered by repeated windows; they may overlap.

    docs: as ``rows.keyed`` makes them; kind: numpy type of a symbol.
    keep_first: a window counts only if an equal one starts earlier (smaller
    did, or same document and smaller pos); otherwise it counts if an equal one
    starts anywhere else.
    """
    runs = materialize(run_rows(docs, shape), "runs")
    anchors = materialize(runs.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"), "anchors")
    shared = materialize(join_keys(runs, anchors, ["anchor"], "times").drop("times"), "shared")
    release(runs, anchors)
    place = F.struct("did", "tkey", "pos")
    classes = materialize(shared.groupBy("anchor", "k1", "k2").agg(F.count("*").alias("members"), F.min(place).alias("head"), F.min("shape").alias("shape")), "classes")

    whole = join_keys(shared, classes.where("members > 1").select("k1", "k2", "head", "members"), ["k1", "k2"], "members")
    if keep_first:
        whole = whole.where(F.struct("did", "tkey", "pos") != F.col("head"))
    whole = whole.select("did", "tkey", "pos", (F.col("shape").bitwiseAND(0xFFFF) + (shape.window - 1)).alias("len"))

    kinds = materialize(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    rows = kinds.where(F.col("kinds") <= most_kinds).agg(F.sum("kinds")).first()[0] or 0
    block = F.when(F.col("kinds") <= most_kinds, F.pmod(F.xxhash64("anchor"), F.lit(-(-rows // block_phrases) or 1).cast("long"))).otherwise(F.lit(-1).cast("long"))
    border = join_keys(classes, kinds, ["anchor"], "kinds").select("head.*", F.struct(F.col("head.pos").alias("pos"), "shape", "anchor", block.alias("block")).alias("run"))
    border = border.groupBy("did", "tkey").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    phrases = materialize(phrase_rows(docs.join(border, ["did", "tkey"]), shape), "phrases")

    def compare(table: pa.Table) -> pa.Table:
        found = Phrases.of(table, kind)
        return found.spans(shape.compare(found, shape.least), shape.window)

    # A number of its own, as few bytes of phrases take long: adaptive execution would join their small partitions.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // (16 * block_phrases))
    dealt = phrases.where("block >= 0").repartition(tasks, "block")
    parts = [whole, dealt.groupBy("block").applyInArrow(compare, SPAN_SCHEMA)]
    if not phrases.where("block < 0").isEmpty():
        single = materialize(window_rows(phrases.where("block < 0"), shape, kind), "windows")
        found = single.groupBy("w1", "w2").agg(F.count("*").alias("times"), F.min(place).alias("head")).where("times > 1")
        single = join_keys(single, materialize(found, "found"), ["w1", "w2"], "times")
        if keep_first:
            single = single.where(F.struct("did", "tkey", "pos") != F.col("head"))
        parts.append(single.select("did", "tkey", "pos", F.lit(shape.window).alias("len")))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    spans = materialize(spans, "spans")
    release(shared, classes, kinds, phrases)
    return spans


def cut_spans(docs: DataFrame, spans: DataFrame, shape: Shape, join_with: bytes | None) -> DataFrame:
    """``doc_id, did, tkey, n, n_removed, n_spans, spans, kept``: each document without its spans.

    n counts its symbols, spans are the maximal removed stretches as (start,
    stop), kept holds the bytes left. join_with None: symbols are bytes;
    otherwise kept words are joined by it. A null text has no symbols.
    """
    gathered = spans.groupBy("did", "tkey").agg(F.collect_list(F.struct("pos", "len")).alias("cuts"))
    joined = docs.join(gathered, ["did", "tkey"], "left").select("doc_id", "did", "tkey", "text", "cuts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                size = block.last - block.first
                bounds = block.offsets if join_with is None else words(block).first
                part = batch.column(4).slice(block.first, size)
                pos, length = (part.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                counts = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                start = np.repeat(bounds[:-1], counts) + pos
                delta = np.zeros(bounds[-1] + 1, np.int64)
                np.add.at(delta, start, 1)
                np.subtract.at(delta, start + length, 1)
                gone = np.cumsum(delta)[:-1] > 0
                fences = np.zeros(bounds[-1] + 1, bool)
                fences[bounds] = True
                first = np.flatnonzero(gone & (fences[:-1] | ~np.concatenate(([False], gone[:-1]))[: len(gone)]))
                last = np.flatnonzero(gone & (fences[1:] | ~np.append(gone[1:], False)[: len(gone)])) + 1
                by_row = np.searchsorted(first, bounds)
                total = np.concatenate(([0], np.cumsum(gone)))
                kept = []
                for r in range(size):
                    raw = block.data[block.offsets[r] : block.offsets[r + 1]]
                    hit = by_row[r + 1] > by_row[r]
                    if join_with is None:
                        kept.append((raw[~gone[bounds[r] : bounds[r + 1]]] if hit else raw).tobytes())
                    else:
                        parts = raw.tobytes().split()
                        kept.append(join_with.join([x for x, g in zip(parts, gone[bounds[r] : bounds[r + 1]].tolist(), strict=True) if not g] if hit else parts))
                pairs = pa.StructArray.from_arrays([as_long(first - np.repeat(bounds[:-1], np.diff(by_row))), as_long(last - np.repeat(bounds[:-1], np.diff(by_row)))], names=["start", "stop"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(block.first, size) for i in range(3)), as_long(np.diff(bounds)), as_long(np.diff(total[bounds])), as_long(np.diff(by_row)), pa.ListArray.from_arrays(pa.array(by_row.astype(np.int32)), pairs), pa.array(kept, pa.binary())],
                    names=["doc_id", "did", "tkey", "n", "n_removed", "n_spans", "spans", "kept"],
                )

    return joined.mapInArrow(scan, "doc_id long, did long, tkey long, n long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary")
