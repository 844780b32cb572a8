"""Pairs of prints with copies, far apart and in blocks, against plain code and against the SQL."""

import itertools
import random

import duckdb
import pytest

from cairn import queries
from cairn.operators import bits, blocks, components, sequences


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def against_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = queries.QUERIES[name](spark, str(folder)), con.execute(queries.ORACLE[name])
    assert got.columns == [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert want and sorted(map(tuple, got.collect())) == want
    return want


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors under three labels, of which the first five of each label are equal to those of the others, and one vector has many copies."""
    rng, folder = random.Random(5), tmp_path_factory.mktemp("vectors")
    shared = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(20 * label + i, shared[i] if i < 5 else shared[0] if i in (7, 8, 12) else [rng.gauss(0, 1) for _ in range(64)], label) for label in range(3) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["hamming_pairs", "video_pairs"])
def test_copies_are_in_all_pairs_of_their_print(spark, vectors, name):
    pairs = against_sql(spark, vectors, name, "embeddings")
    heads = {a for a, b, d in pairs if d == 0} - {b for a, b, d in pairs if d == 0}
    assert any(d and a not in heads and b not in heads for a, b, d in pairs)


def test_calibration_sees_pairs_at_any_distance(spark, vectors):
    ((most, least, middle),) = against_sql(spark, vectors, "calibration_threshold", "embeddings")
    assert most > 16 and least == 0 and middle == most / 2


def test_extremes_are_of_two_ids(spark):
    rows = [(1, [0], "x"), (2, [3], "x"), (3, [15], "y"), (4, [-1], None), (3, [15], "x")]
    prints = spark.createDataFrame(rows, "id long, words array<long>, label string")
    assert tuple(bits.extremes(prints).first()) == (4, 2)
    assert tuple(bits.extremes(prints.where("id = 3")).first()) == (None, None)
    assert tuple(bits.extremes(prints.where("id > 4")).first()) == (None, None)
    assert tuple(bits.extremes(spark.createDataFrame([(1, [7], "x"), (2, [7], "x")], prints.schema)).first()) == (0, None)


@pytest.mark.parametrize(("width", "threshold"), [(1, 6), (1, 14), (5, 40)])
def test_patterns_and_blocks_find_the_same(spark, monkeypatch, width, threshold):
    monkeypatch.setattr(bits, "BLOCK", 16)
    rng = random.Random(threshold)
    words = [rng.getrandbits(64 * width) for _ in range(25)]
    words += [w ^ sum(1 << i for i in rng.sample(range(64 * width), threshold + extra)) for w in words for extra in (-1, 0, 1)]
    want = {(i, j, (v ^ w).bit_count()) for (i, v), (j, w) in itertools.combinations(enumerate(words), 2) if (v ^ w).bit_count() <= threshold}
    heads = spark.createDataFrame([(i, [signed(w >> (64 * k) & (2**64 - 1)) for k in range(width)]) for i, w in enumerate(words)], "id long, words array<long>")
    bounds, radii, _ = bits._pieces(64 * width, threshold, len(words))
    assert {tuple(r) for r in bits.posted_pairs(heads, threshold, bounds, radii).collect()} == want
    assert sorted(map(tuple, bits.compared_pairs(heads, len(words), threshold).collect())) == sorted(want)


def test_large_classes_are_expanded_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 2)
    rows = [(f"{i:02}", [0 if i < 9 else 1 if i < 13 else i]) for i in range(16)]
    got = sorted(map(tuple, bits.all_hamming_pairs(spark.createDataFrame(rows, "id string, words array<long>"), 1).collect()))
    assert got == [(a, b, (v[0] ^ w[0]).bit_count()) for (a, v), (b, w) in itertools.combinations(rows, 2) if (v[0] ^ w[0]).bit_count() <= 1]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events of users: 25, 35 and 45 have those of user 5, users 3 and 13 too few to compare, and some values are null."""
    rng, folder = random.Random(8), tmp_path_factory.mktemp("events")
    values = {u: [round(rng.random() * 200, 2) for _ in range(rng.randint(9, 40))] for u in range(1, 50)}
    values |= {u: values[5] for u in (25, 35, 45)} | {u: [1.0] * 6 for u in (3, 13)}
    values[7][2] = values[10][4] = values[20][0] = None
    rows = [(100 * u + i, u, v) for u, own in values.items() for i, v in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_copies_of_sequences_are_in_all_pairs(spark, events):
    pairs = against_sql(spark, events, "ber_pairs", "events")
    heads = {a for a, b, ber in pairs if ber == 0} - {b for a, b, ber in pairs if ber == 0}
    assert any(ber and a not in heads and b not in heads for a, b, ber in pairs)
    assert {a for a, _ in against_sql(spark, events, "ber_clusters", "events")} == {i for a, b, _ in pairs for i in (a, b)}


def test_sequences_meet_in_blocks(spark, monkeypatch):
    """Lengths from 7 to 60, neighbours just within and beyond the rate, at all shifts, in blocks and parts smaller than the data."""
    for name, value in (("BLOCK", 16), ("ROWS", 4), ("COLUMNS", 8)):
        monkeypatch.setattr(sequences, name, value)
    rng = random.Random(3)
    words = [[rng.getrandbits(32) for _ in range(n)] for n in (7, 8, 9, 12, 20, 21, 40, 60)]
    for w in [*words]:
        for cut, share in ((0, 0.09), (1, 0.099), (2, 0.101), (1, 0.12), (3, 0.0)):
            near = w[cut:]
            for bit in rng.sample(range(32 * len(near)), int(32 * len(near) * share)):
                near[bit // 32] ^= 1 << bit % 32
            words.append(near)

    def rate(x, y):
        rates = [1.0]
        for shift in sequences.SHIFTS:
            m = min(len(x), len(y)) - abs(shift)
            if m >= 8:
                rates.append(sum((x[i + max(shift, 0)] ^ y[i + max(-shift, 0)]).bit_count() for i in range(m)) / (m * 32))
        return min(rates)

    data = [(f"{i:03}", ("cp", "lc")[i % 2], w) for i, w in enumerate(words)]
    got = sorted(map(tuple, sequences.all_ber_pairs(spark.createDataFrame(data, "id string, tag string, words array<long>"), 0.1).collect()))
    want = [(a, b, rate(x, y)) for (a, s, x), (b, t, y) in itertools.combinations(data, 2) if s == t and rate(x, y) <= 0.1]
    assert got == want and len({r for *_, r in want}) > 5


def test_clusters_need_no_pairs_of_copies(spark, vectors):
    """What stats_counters counts: the components of collapsed pairs are those of all pairs."""
    prints = queries._video_prints(spark, str(vectors))
    every = components.connected_components(queries.video_pairs(spark, str(vectors)))
    assert sorted(map(tuple, bits.clusters(prints, 40).collect())) == sorted(map(tuple, every.collect()))
