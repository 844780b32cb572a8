"""Language ID by a byte convolutional network, trained in numpy.

Each window of ``WINDOW`` bytes is seen as one-hot bytes. Filters of several
widths slide over it, a rectified bias follows, each filter keeps its maximum
over the window, and a softmax layer turns the maxima into languages. A text is
cut into windows that cover it wholly; their log-probabilities are added, each
weighed by its bytes.

A convolution over one-hot bytes is a sum of table rows, so inference adds
``table[offset][byte]`` instead of multiplying matrices, and training only
touches the rows at each filter's maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship
from .rows import smallest
from .textkernel import blocks

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled documents that the network is trained on at most; of more, those with the smallest hash of their doc_id.
FIT_DOCS = 3_000
#: Windows of them in all, at most (one for each document if they are more).
FIT_WINDOWS, EPOCHS, BATCH = 6_000, 6, 64
UNKNOWN = "und"

#: Byte classes: letters and controls are folded so that case is not learned twice.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass
class Network:
    """tables[w]: (width, 256, filters); bias per filter; the softmax layer; languages in code-point order."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of each filter over each row of bytes, and where they are."""
        best, where = [], []
        for table in self.tables:
            width = len(table)
            n = windows.shape[1] - width + 1
            total = table[0][windows[:, :n]]
            for k in range(1, width):
                total = total + table[k][windows[:, k : k + n]]
            at = total.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(total, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def some_windows(data: np.ndarray, n: int, seed: int, window: int = WINDOW) -> np.ndarray:
    """``n`` rows of ``window`` bytes, or all if there are fewer, chosen by ``seed`` from those that cover the data; the last is filled up with blanks."""
    rows = max(1, -(-len(data) // window))
    pick = np.random.default_rng(seed).choice(rows, min(n, rows), replace=False)
    out = np.full((len(pick), window), 32, np.uint8)
    for row, i in zip(out, pick, strict=True):
        part = data[i * window : (i + 1) * window]
        row[: len(part)] = FOLD[part]
    return out


def train(windows: np.ndarray, langs: list[str], seed: int = 3) -> Network:
    """From rows of bytes and the language of each, in a given order: Adam on the cross-entropy of single windows."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    goal = np.array([languages.index(lang) for lang in langs])
    weights = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    count = FILTERS * len(WIDTHS)
    net = Network(languages, weights, np.zeros(count, np.float32), rng.normal(0, 0.3, (count, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.tables, net.bias, net.out, net.out_bias]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            x, y = windows[order[i : i + BATCH]], goal[order[i : i + BATCH]]
            pooled, where = net.pooled(x)
            hidden = np.maximum(pooled + net.bias, 0)
            wrong = np.exp(net.log_probabilities(pooled))
            wrong[np.arange(len(y)), y] -= 1
            wrong /= len(y)
            back = (wrong @ net.out.T) * (hidden > 0)
            grads = []
            for j, table in enumerate(net.tables):
                grad = np.zeros_like(table)
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(table)):
                    seen = np.take_along_axis(x, where[j] + k, 1)
                    np.add.at(grad[k], (seen, np.arange(FILTERS)[None, :]), part)
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ wrong, wrong.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: Network, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text of a column."""
    pairs = [[(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)] for t in net.tables]
    names: list[str] = []
    scores: list[np.ndarray] = []
    for block in blocks(column, 1 << 17):
        sizes = np.diff(block.offsets)
        rows = np.maximum(1, -(-sizes // WINDOW))
        flat = np.full(int(rows.sum()) * WINDOW, 32, np.uint8)
        first = np.concatenate(([0], np.cumsum(rows)))
        target = np.arange(len(block.data)) + np.repeat(first[:-1] * WINDOW - block.offsets[:-1], sizes)
        flat[target] = FOLD[block.data]
        windows = flat.reshape(-1, WINDOW)
        used = np.full(len(windows), WINDOW)
        used[first[1:] - 1] = np.maximum(1, sizes - (rows - 1) * WINDOW)
        joint = (flat[:-1].astype(np.int32) << 8) + flat[1:]
        joint = np.append(joint, 0).reshape(-1, WINDOW)
        best = []
        for table, parts in zip(net.tables, pairs, strict=True):
            width = len(table)
            n = WINDOW - width + 1
            pooled = np.empty((len(windows), FILTERS), np.float32)
            for i in range(0, len(windows), 64):
                total = None
                for k, part in zip(range(0, width, 2), parts, strict=True):
                    source = joint if len(part) > 256 else windows
                    add = part.take(source[i : i + 64, k : k + n], axis=0)
                    total = add if total is None else np.add(total, add, out=total)
                pooled[i : i + 64] = total.max(1)
            best.append(pooled)
        logs = net.log_probabilities(np.concatenate(best, 1)) * used[:, None]
        text_logs = np.add.reduceat(logs, first[:-1], axis=0) / WINDOW
        text_logs -= text_logs.max(1, keepdims=True)
        shares = np.exp(text_logs)
        shares /= shares.sum(1, keepdims=True)
        names += [net.languages[i] for i in shares.argmax(1)]
        scores.append(shares.max(1))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Network | None:
    """A network from documents with text, letters and a lang that are not held out; None if there are none.

    At most ``fit_docs`` documents are used, those with the smallest hash of doc_id,
    text and lang. Their windows are chosen by the executors, about ``FIT_WINDOWS``
    in all, so what the driver holds grows neither with the data nor with their texts.
    """
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text", "lang"), 1).alias("key")
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    sample = materialize(smallest(materialize(usable.select(key), "keys"), "key", fit_docs), "sample")
    n = sample.count()
    if n == 0:
        return None
    per_text = max(1, FIT_WINDOWS // n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [some_windows(np.frombuffer(text.as_py().encode(), np.uint8), per_text, k.as_py()).tobytes() for k, text in zip(batch.column(0), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(picked, pa.binary())], names=["key", "lang", "windows"])

    texts = usable.select(key, "lang", "text").join(F.broadcast(sample), "key", "left_semi")
    # Rows of one key are equal, so which of them stays is of no effect.
    rows = sorted(texts.mapInArrow(scan, "key long, lang string, windows binary").dropDuplicates(["key"]).collect(), key=lambda r: r["key"])
    cut = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in rows]
    return train(np.concatenate(cut), [r["lang"] for r, windows in zip(rows, cut, strict=True) for _ in windows])


def language_id(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of docs(doc_id, text, lang).

    The prediction reads the whole text and nothing else. ``net`` may bring a
    trained network; without it one is trained on docs. lang_pred is one of the
    learned languages, or ``und`` with score 0 if the text is null or has no
    letter (Unicode category L), or if there was nothing to learn from.

    A null doc_id is not held out. Repeated rows have equal results. An empty
    table gives an empty table. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = learn(rows) if net is None else net
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    if net is None:
        return out.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(net, batch.column(3))
            letters = batch.column(2).to_pylist()
            names = [n if ok else UNKNOWN for n, ok in zip(names, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, scores, 0.0).astype(np.float64))], names=["doc_id", "held_out", "lang_pred", "score"])

    return out.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
