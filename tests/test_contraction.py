"""Connected components of edges that lie in many parts."""

import random

from cairn.operators import components


def test_parts_are_joined(spark, monkeypatch):
    """A chain, a star and random edges, dealt over many parts."""
    monkeypatch.setattr(components, "AT_ONCE", 50)
    rng = random.Random(2)
    names = rng.sample(range(-500, 5000), 900)
    edges = [*zip(names[:40], names[1:40]), *((names[200], x) for x in names[201:300])] + [tuple(rng.sample(names[300:], 2)) for _ in range(320)]
    rng.shuffle(edges)
    root = {x: x for x in names}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    frame = spark.createDataFrame(edges + [(7, 7), (None, names[0])], "a long, b long").repartition(16)
    assert dict(components.connected_components(frame).collect()) == {x: root[x] for pair in edges for x in pair}


def test_chains_that_lie_together_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "_by_rounds", None)
    frame = spark.range(10_000).selectExpr("cast(id as int) AS a", "cast(id + 1 as int) AS b").where("a % 10 != 9").coalesce(1)
    found = components.connected_components(frame)
    assert found.schema["id"].dataType.simpleString() == "int" and found.where("component != id - id % 10").isEmpty() and found.count() == 10_000
