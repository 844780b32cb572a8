"""Runs of words and their hashes over whole batches, against plain code."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import shingling, similar, textnorm


@pytest.mark.parametrize("before", [[], ["zz yy xx"]])
def test_runs_and_md5_are_those_of_plain_code(monkeypatch, before):
    monkeypatch.setattr(shingling, "AT_ONCE", 7)
    rng = random.Random(1)
    texts = ["a b c d e f g", "", "one two", " x  y ", "q" * 70 + " " + "w " * 6, "é ü 한 " * 9, "   ", "a" * 47 + " b c d e", "a" * 48 + " b c d e"]
    texts += [" ".join("w" * rng.randint(1, 14) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    words = [[w for w in t.split(" ") if w] for t in texts]
    want = [[" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else w for w in words]
    data, starts, ends, counts = shingling.runs(pa.array(before + texts).slice(len(before)), 5)
    assert [bytes(data[i:j]).decode() for i, j in zip(starts, ends, strict=True)] == [s for run in want for s in run] and list(counts) == list(map(len, want))
    assert [h.tobytes() for h in shingling.md5(data, starts, ends)] == [hashlib.md5(s.encode()).digest()[:8] for run in want for s in run]
    assert len(shingling.runs(pa.array([], pa.string()), 5)[1]) == 0


def test_minima_and_different_values(monkeypatch):
    monkeypatch.setattr(similar, "AT_ONCE", 4)
    runs = [[similar.PRIME - 1] * 9, [0, 1, 2, 3], [5, 5, 6, 7, 7], [1], list(range(40))]
    values, counts = np.array(sum(runs, [])), np.array([len(r) for r in runs])
    assert list(similar.several(values, counts, 4)) == [len(set(r)) >= 4 for r in runs]
    want = [[min((a * x + b) % similar.PRIME for x in r) for a, b in zip(similar.A, similar.B, strict=True)] for r in runs]
    assert similar.minima(values, np.concatenate(([0], np.cumsum(counts)))).tolist() == want


def test_collapse_looks_at_a_text_once(spark):
    rows = [("a  b",), (" \t x ",), (" \n\u0085 \x1c",), ("",), (None,), ("　한  글",)]
    texts = spark.createDataFrame(rows, "text string").select(textnorm.collapse(F.col("text")).alias("normal"))
    assert [r.normal for r in texts.collect()] == ["a b", "x", None, None, None, "한 글"]
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_exact_pairs_where_most_shingles_are_of_one_file(spark, threshold):
    """Shingles of one file are counted in the order of the rarest, and are posted nowhere."""
    rng = random.Random(6)
    texts = [" ".join([f"{i % 4}w{k}" for k in range(rng.randint(6, 40))] + [f"own{i}x{k}" for k in range(rng.randint(0, 25))]) for i in range(50)]
    texts += texts[:3]
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts]
    heads = {s: i for i, s in reversed(list(enumerate(sets)))}
    want = {(i, j, len(s & t), len(s | t)) for s, i in heads.items() for t, j in heads.items() if i < j and len(s & t) >= threshold * len(s | t)}
    want |= {(heads[s], i, len(s), len(s)) for i, s in enumerate(sets) if heads[s] != i}
    files = spark.createDataFrame(list(enumerate(texts)), "path int, normal string")
    assert {tuple(r) for r in similar.exact_pairs(files, threshold).collect()} == want and len(want) >= 3
    assert len({bytes(r.key) for r in similar.shingle_sets(files).collect()}) == len(heads)


def test_export_rows_are_read_from_the_groups(spark):
    """The groups are found once, not for their numbers and again for their rows."""
    from cairn import queries

    assert not any("documents" in f for f in queries.QUERIES["flat_rows"](spark, "/root/testdata/sf0.001").inputFiles())
