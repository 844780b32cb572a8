"""Media fingerprints from decoded pixels and samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import let

SIDE = 32


def dhash_bits(gray: np.ndarray) -> int:
    """64 bits, left brighter than right, of an 8 x 9 gray image."""
    bits = (gray[:, :-1] > gray[:, 1:]).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


def phash_bits(gray: np.ndarray) -> int:
    """64 bits of a 32 x 32 gray image: low frequencies over the median of all but the first."""
    n = np.arange(SIDE)
    basis = np.cos(math.pi * np.outer(2 * n + 1, n) / (2 * SIDE))
    low = (basis @ gray @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return int("".join("1" if b else "0" for b in bits), 2)


def resized(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means, for images that come larger."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(0).cumsum(1)
    edges = [np.linspace(0, size, parts + 1).astype(int) for size, parts in zip(pixels.shape, (rows, columns), strict=True)]
    (top, left), (bottom, right) = zip(*[(e[:-1], np.maximum(e[1:], e[:-1] + 1)) for e in edges], strict=True)
    area = np.outer(bottom - top, right - left)
    return (sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]) / area


def canonical(pixels: np.ndarray, bits) -> int:
    """Least hash over four turns and mirroring."""
    turned = [np.rot90(pixels, k) for k in range(4)]
    return min(bits(v) for t in turned for v in (t, np.fliplr(t)))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pixel_hash(kind: str = "dhash", rotation: bool = False):
    """A pandas UDF over array<float> pixels with height and width: array of one 64-bit word, null if unreadable."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        shape, bits = ((8, 9), dhash_bits) if kind == "dhash" else ((SIDE, SIDE), phash_bits)

        def one(p, h, w):
            if p is None or h * w != len(p) or not len(p):
                return None
            image = np.asarray(p, float).reshape(int(h), int(w))
            make = lambda v: bits(resized(v, *shape))
            return [signed(canonical(image, make) if rotation else make(image))]

        return pd.Series([one(*x) for x in zip(pixels, height, width, strict=True)], dtype=object)

    return run


RATE, FRAME, HOP, PITCHES, SEGMENTS, LEAST_FRAMES = 22_050, 4096, 2048, 12, 21, 8


def chroma_hex(samples: np.ndarray) -> str | None:
    """256 bits as hex: for 21 segments of time, which of 12 pitch classes are above the segment's median; null below 8 frames or a second."""
    x = np.asarray(samples, np.float32)[: RATE * 120]
    if len(x) < max(RATE, FRAME + (LEAST_FRAMES - 1) * HOP):
        return None
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    size = np.abs(np.fft.rfft(frames))
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((freq > 50) & (freq < 5000))
    # Class 0 is C: the tone of 440 Hz has the number 69.
    of_class = (np.round(12 * np.log2(freq[used] / 440) + 69).astype(int) % PITCHES)[:, None] == np.arange(PITCHES)
    classes = size[:, used] @ of_class
    total = classes.sum(1, keepdims=True)
    classes = np.divide(classes, total, out=np.zeros_like(classes), where=total > 0)
    parts = np.array([c.mean(0) for c in np.array_split(classes, min(SEGMENTS, len(classes)))])
    bits = (parts > np.median(parts, axis=1, keepdims=True)).ravel()
    return np.packbits(np.append(bits, np.zeros(256 - len(bits), bool))).tobytes().hex()


@F.pandas_udf(T.ArrayType(T.LongType()))
def chroma(samples: pd.Series) -> pd.Series:
    """``chroma_hex`` of mono signals, as four 64-bit words."""

    def one(x):
        text = None if x is None else chroma_hex(x)
        return text and [signed(int(text[i : i + 16], 16)) for i in range(0, 64, 16)]

    return pd.Series([one(x) for x in samples], dtype=object)


def median_words(values: Column) -> Column:
    """64 numbers -> one word, bit i (from the top) set where value i is above the median; all in expressions."""
    middle = let(F.sort_array(values), lambda v: (F.get(v, 31) + F.get(v, 32)) / 2)
    return let(middle, lambda m: F.array(F.conv(F.array_join(F.transform(values, lambda v: F.when(v > m, "1").otherwise("0")), ""), 2, -10).cast("long")))
