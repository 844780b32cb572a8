"""Vectorised byte and word hashing over Arrow string columns.

Texts are handled as the UTF-8 bytes that Arrow already holds. A block of whole
documents is hashed at once: prefix sums of ``table[byte] * base**i`` modulo
2**64 give the hash of any byte range as one subtraction and one product, and
the same trick over word hashes gives the hash of any run of words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
BLOCK_BYTES = 1 << 18
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_BLANK = byte_set(BLANKS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Base:
    """One hash family: a random byte table, an odd base and its inverse."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self._power = self._back = np.ones(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._power) < n:
            size = max(n, BLOCK_BYTES + 4096)
            self._power, self._back = (self._run(x, size) for x in (self.base, self.inverse))
        return self._power[:n], self._back[:n]

    @staticmethod
    def _run(x: int, n: int) -> np.ndarray:
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums, with a leading zero, over uint64 symbols."""
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers(len(symbols))[0], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of symbol ranges [start, stop)."""
        return mix((sums[stop] - sums[start]) * self.powers(len(sums))[1][start] + (stop - start).astype(np.uint64))


@cache
def base(seed: int) -> Base:
    return Base(seed)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Block:
    """Whole documents first..last of a batch; ``offsets`` has one entry more than rows."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Split a string column into blocks of about ``limit`` bytes of whole documents; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    n, kind = len(column), np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Block(i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a block: byte ranges, and ``first[r]``..``first[r + 1]`` are those of row r."""

    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, separator: np.ndarray = IS_BLANK) -> Words:
    """Maximal runs of bytes outside ``separator``; none crosses a document border."""
    inside = ~separator[block.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(start, stop, np.searchsorted(start, block.offsets))


def word_hashes(block: Block, found: Words, seed: int, fold: bool = False) -> np.ndarray:
    """One 64-bit hash a word; ``fold`` lower-cases A-Z first."""
    family = base(seed)
    sums = family.sums(family.table[LOWER[block.data] if fold else block.data])
    return family.ranges(sums, found.start, found.stop)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row that each item belongs to, from item bounds by row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """list<long> from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), as_long(np.ascontiguousarray(values)))
