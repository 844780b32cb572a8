"""Connected components by contraction of parts and label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship

#: Edges that are contracted together.
AT_ONCE = 1_000_000


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, component``: the smallest id that each id reaches over ``edges(a, b)``.

    ``vertices(id)``, if given, adds ids without edges, each its own component.
    Each round every vertex takes the smallest label around it and then that
    label's own label, so chains shorten by half or more a round; rounds go on
    until no label changes. A star settles in two rounds. Edges and labels are
    tables in the shared scratch folder: nothing is collected, and a lost
    executor costs one round at most. Self-loops, repeated edges and null ends
    are harmless. Where ids are whole numbers, edges that lie together are
    contracted first, and only what they leave between parts goes by rounds.
    """
    clean = edges.select("a", "b").where("a != b")
    kind = clean.schema["a"].dataType
    if isinstance(kind, T.LongType | T.IntegerType) and clean.schema["b"].dataType == kind:
        found = _contracted(clean).select(F.col("id").cast(kind).alias("id"), F.col("component").cast(kind).alias("component"))
    else:
        found = _by_rounds(clean)
    if vertices is None:
        return found
    return vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _contracted(clean: DataFrame) -> DataFrame:
    """id, component: each part of the edges gives its vertices the least of their component there, its root; a vertex of several parts joins their roots.

    The least id of a component is its own root wherever it is, so the least
    among joined roots is the least of all.
    """
    ship(clean.sparkSession)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(2)))
            count += batch.num_rows
            if count >= AT_ONCE:
                yield _star(held)
                held, count = [], 0
        if count:
            yield _star(held)

    found = materialize(clean.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(stars, "id long, root long"), "stars")
    labels = materialize(found.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high")), "labels")
    torn = labels.where("low != high")
    if torn.isEmpty():
        return labels.select("id", F.col("low").alias("component"))
    joined = _by_rounds(found.join(torn, "id").where("root != low").select(F.col("low").alias("a"), F.col("root").alias("b")))
    return labels.join(joined.select(F.col("id").alias("low"), "component"), "low", "left").select("id", F.coalesce("component", "low").alias("component"))


def _star(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    ids, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            next_ = root[root]
            if (next_ == root).all():
                break
            root = next_
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "root"])


def _by_rounds(clean: DataFrame) -> DataFrame:
    both = materialize(clean.select(F.col("a").alias("id"), F.col("b").alias("other")).union(clean.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("other"), F.col("label").alias("around")), "other")
        hooked = labels.unionByName(seen.select("id", F.col("around").alias("label"))).groupBy("id").agg(F.min("label").alias("next"))
        # The old label of the root may know better than the root's label does.
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("root"))
        moved = hooked.join(jump, "next", "left").select("id", F.least("next", "root").alias("label"))
        moved = materialize(moved.join(labels.select("id", F.col("label").alias("old")), "id"), "labels")
        changed = not moved.where("label != old").isEmpty()
        labels = moved.select("id", "label")
        if not changed:
            break
    return labels.select("id", F.col("label").alias("component"))
