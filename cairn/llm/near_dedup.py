"""MinHash near-dedup with bottom-k sketches from one hash function.

The sketch of a document is the ``k`` smallest hashes of its shingle set, all
from one hash function. Among the k smallest of the union of two sets, each is
in both with probability J, so two documents of similarity ``threshold`` share
about ``threshold * k`` sketch values, and at least ``need`` but for a chance
of about one in a million (a set below k values: exactly the least that any
partner within the threshold leaves). Prefix filtering on the values, rarest first, then says
that the two share one of each other's ``size - need + 1`` rarest values; only
those are put on inverted lists.

* Lists of up to ``list_limit`` documents generate all their pairs.
* Longer lists elect a centre, the member with the most exact copies, and
  every member is compared with it. Members that link to it need no
  pairs among themselves: they are one component already. The others elect the
  next centre, for ``rounds`` rounds. Whatever a list then still holds outside
  its main component is compared with the whole list, block by block.

Inside the join that makes the pairs, bit sets of the sketches already rule out
most that cannot reach the threshold. The others are filtered by the estimate
from their union sketch, the k smallest values of both, of which the share that
lies in both estimates the similarity. Links are confirmed on the full sets,
which are made only for what is left. Documents with equal sets are collapsed
first, so a group of copies is one entry of every list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize
from .rows import join_keys, keyed
from .textkernel import as_long, base, blocks, lists, mix, word_hashes, words

#: Candidate documents up to which their ids are broadcast to filter the texts (16 bytes each); beyond it they are joined.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Setting:
    shingle: int = 5
    percent: int = 80
    k: int = 64
    list_limit: int = 48
    rounds: int = 2
    query_block: int = 128
    member_block: int = 512

    def need(self, n: int) -> int:
        """Sketch values that two linked documents share at least, for a sketch of n values.

        Below k the sketch is the whole set. A partner of m values has
        ``percent * (n + m) / (100 + percent)`` or more in common with it, of
        which all but m - k are in the partner's sketch.
        """
        p, t = self.percent, self.percent / 100
        if n >= self.k:
            return max(1, math.floor(t * n - 5 * math.sqrt(n * t * (1 - t))))
        return max(1, min(-(-p * (n + m) // (100 + p)) - max(0, m - self.k) for m in range(-(-p * n // 100), 100 * n // p + 1)))


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct shingle hashes of each row, by block.

    A-Z are lower-cased. A text of fewer words than a shingle, but not none,
    has its whole sequence as its one shingle.
    """
    family = base(12)
    for block in blocks(column):
        found = words(block)
        hashes = word_hashes(block, found, 11, fold=True)
        sums, first = family.sums(hashes), found.first
        start = np.arange(len(hashes))
        ends = np.repeat(first[1:], found.counts)
        begins = np.repeat(first[:-1], found.counts)
        stop = np.minimum(start + shingle, ends)
        whole = family.ranges(sums, start, stop)
        use = (start + shingle <= ends) | (start == begins)
        bounds = np.concatenate(([0], np.cumsum(use)))[first]
        whole = whole[use]
        yield block.first, [np.unique(whole[bounds[r] : bounds[r + 1]]) for r in range(block.last - block.first)]


def sketches(rows: DataFrame, s: Setting) -> DataFrame:
    """Set size n, 128-bit digest d1, d2 of the set, its k smallest hashes, and 256 bits set by their low ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(3), s.shingle):
                n = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (mix(flat ^ np.uint64(0x9E3779B97F4A7C15)), mix(flat + np.uint64(0x632BE59BD9B4E019)))]
                at = np.concatenate(([0], np.cumsum(n)))
                d1, d2 = (x[at[1:]] - x[at[:-1]] for x in sums)
                k = np.minimum(n, s.k)
                kept = np.concatenate([x[: s.k] for x in sets])
                bits = np.zeros((len(sets), 4), np.uint64)
                np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), k), (kept >> np.uint64(6)) & np.uint64(3)), np.uint64(1) << (kept & np.uint64(63)))
                bits = pa.StructArray.from_arrays([as_long(np.ascontiguousarray(bits[:, i])) for i in range(4)], names=["b0", "b1", "b2", "b3"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, len(sets)) for i in range(3)), pa.array(n), as_long(d1), as_long(d2), bits, lists(kept, k)],
                    names=["doc_id", "did", "tkey", "n", "d1", "d2", "bits", "sketch"],
                )

    return rows.select("doc_id", "did", "tkey", "text").mapInArrow(scan, "doc_id long, did long, tkey long, n long, d1 long, d2 long, bits struct<b0:long,b1:long,b2:long,b3:long>, sketch array<long>")


def full_sets(rows: DataFrame, s: Setting) -> DataFrame:
    """``did, tkey, items``: the whole set of each document, as sorted 8-byte hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), s.shingle):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(sets)) for i in range(2)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["did", "tkey", "items"])

    return rows.select("did", "tkey", "text").mapInArrow(scan, "did long, tkey long, items binary")


def candidates(heads: DataFrame, s: Setting) -> tuple[DataFrame, DataFrame]:
    """(pairs, long): pairs a < b of heads that short lists generate, and the entries v, id, n, bits of long lists."""
    values = heads.select("id", F.explode("sketch").alias("v"))
    sizes = materialize(values.groupBy("v").agg(F.count("*").alias("docs")).where("docs > 1"), "sizes")
    # A value of one document links nothing, so it is enough to know how many there are: those are the rarest.
    shared = values.join(sizes, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("docs", "v"))).alias("shared"))
    shared = heads.select("id", "n", "bits", F.size("sketch").alias("size")).join(shared, "id")
    need = F.element_at(F.array(*[F.lit(s.need(n)) for n in range(1, s.k + 1)]), F.col("size"))
    singles = F.col("size") - F.size("shared")
    room = F.col("size") - need + 1 - singles
    posted = shared.where(room > 0).select("id", "n", "bits", F.explode(F.slice("shared", F.lit(1), room)).alias("x"))
    posted = materialize(posted.select(F.col("x.v").alias("v"), "id", "n", "bits"), "posted")
    lengths = materialize(posted.groupBy("v").agg(F.count("*").alias("length")).where("length > 1"), "lengths")
    short = materialize(posted.join(lengths.where(F.col("length") <= s.list_limit), "v", "left_semi"), "short")
    left, right = _side(short, 1), _side(short, 2)
    pairs = left.join(right, (F.col("v1") == F.col("v2")) & (F.col("id1") < F.col("id2")) & _may_link(s)).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    long = posted.join(lengths.where(F.col("length") > s.list_limit), "v", "left_semi")
    return materialize(pairs.distinct(), "pairs"), materialize(long, "long")


def _side(entries: DataFrame, i: int) -> DataFrame:
    return entries.select(*[F.col(c).alias(f"{c}{i}") for c in ("v", "id", "n", "bits")])


def _may_link(s: Setting):
    """Sizes and sketch bits leave a link possible, over columns n1, n2, bits1, bits2.

    A value of one sketch whose bit the other lacks is not shared, so the bits
    bound from above how many values two sketches share.
    """
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    need = F.when(small >= s.k, F.lit(s.need(s.k))).otherwise(F.ceil(small * s.percent / 100) - F.greatest(large - s.k, F.lit(0)))

    def most(x: int, y: int):
        missing = [F.bit_count(F.col(f"bits{x}.b{i}").bitwiseAND(F.bitwise_not(F.col(f"bits{y}.b{i}")))) for i in range(4)]
        return F.least(F.col(f"n{x}"), F.lit(s.k)) - (missing[0] + missing[1] + missing[2] + missing[3])

    return (small * 100 >= large * s.percent) & (most(1, 2) >= need) & (most(2, 1) >= need)


def sets_of(rows: DataFrame, heads: DataFrame, ids: DataFrame, s: Setting) -> DataFrame:
    """``id, items``: full sets of the heads in ids(id), by one scan of the texts."""
    wanted = materialize(heads.join(ids.distinct(), "id", "left_semi").select("id", "did", "tkey"), "wanted")
    keys = wanted.select("did", "tkey")
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_IDS else keys
    sets = full_sets(rows.join(keys, ["did", "tkey"], "left_semi").dropDuplicates(["did", "tkey"]), s)
    return materialize(sets.join(wanted, ["did", "tkey"]).select("id", "items"), "sets")


def estimated(pairs: DataFrame, heads: DataFrame, s: Setting) -> DataFrame:
    """Those of pairs(a, b) whose union sketch leaves the threshold within reach.

    Of the k smallest values of two sets together, each lies in both with
    probability J. A pair goes if the share is five standard deviations below
    the threshold. If both sketches are whole sets, the union is whole and the
    share is the similarity itself.
    """
    sides = [heads.select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    least = s.need(s.k)

    @F.pandas_udf("boolean")
    def within_reach(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y, strict=True):
            joint = np.concatenate((one, two)).view(np.uint64)
            joint.sort()
            twice = joint[1:] == joint[:-1]
            if len(one) < s.k and len(two) < s.k:
                common = int(np.count_nonzero(twice))
                out.append(100 * common >= s.percent * (len(joint) - common))
            else:
                # The k-th distinct value ends the union sketch; a value in both is counted at its second place.
                end = int(np.searchsorted(np.cumsum(np.append(True, ~twice)), s.k, "right"))
                out.append(int(np.count_nonzero(twice[: end - 1])) >= least)
        return pd.Series(out, dtype=bool)

    return materialize(both.where(within_reach("sketch_a", "sketch_b")).select("a", "b"), "estimated")


def confirmed(pairs: DataFrame, sets: DataFrame, s: Setting) -> DataFrame:
    """``a, b, linked``: each pair, judged on the full sets."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y, strict=True):
            joint = np.concatenate((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)))
            joint.sort()
            common = int(np.count_nonzero(joint[1:] == joint[:-1]))
            out.append(100 * common >= s.percent * (len(joint) - common))
        return pd.Series(out, dtype=bool)

    return materialize(both.select("a", "b", linked("x", "y").alias("linked")), "judged")


def near_dedup(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id, did, tkey, n_shingles, component_id, n_links, kept`` for each row of docs(doc_id, text).

    Documents are linked if the Jaccard similarity of their shingle sets is
    ``percent`` hundredths or more; component_id is the smallest doc_id that
    links reach, n_links the links of the document's distinct set that were
    confirmed, kept whether the document is that smallest one.

    Null, empty and blank texts have an empty set and stay alone. Equal sets
    are linked whatever their texts. Repeated rows (same doc_id and text) have
    equal results; rows of one doc_id with different sets are linked only as
    their sets are. Rows without doc_id are documents of their own, after all
    others: they report the smallest doc_id that they reach, and null if there
    is none; then one of their texts is kept. An empty table gives an empty
    table. Other columns are ignored.
    """
    s = setting
    rows = keyed(docs)
    made = materialize(sketches(rows, s), "sketches")
    group = ["n", "d1", "d2"]
    head = F.struct(F.col("doc_id").isNull().alias("unnamed"), "did", "tkey", "bits", "sketch")
    heads = made.where("n > 0").groupBy(*group).agg(F.count("*").alias("copies"), F.min(head).alias("h"))
    heads = _with_vertices(materialize(heads.select(*group, "copies", "h.*"), "heads"))
    links = _links(rows, heads, s)
    component = connected_components(links, heads.select("id"))
    named = materialize(heads.select("id", *group, F.struct("unnamed", "did").alias("place")).join(component, "id"), "named")
    first = materialize(named.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("sets")), "first")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = join_keys(named, first, ["component"], "sets").join(degree, "id", "left").select(*group, "first", "n_links")
    kept = ["doc_id", "did", "tkey", "n", "first", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")]
    grouped = made.where("n > 0").select("doc_id", "did", "tkey", *group).join(named, group).select(*kept)
    alone = made.where("n = 0").select("doc_id", "did", "tkey", "n", F.struct(F.col("doc_id").isNull().alias("unnamed"), "did").alias("first"), F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone).select(
        "doc_id",
        "did",
        "tkey",
        F.col("n").alias("n_shingles"),
        F.when(~F.col("first.unnamed"), F.col("first.did")).alias("component_id"),
        "n_links",
        (F.col("did") == F.col("first.did")).alias("kept"),
    )


def _with_vertices(heads: DataFrame) -> DataFrame:
    """heads with an ``id`` of their own each: the did, or a hash of the set where several sets share a did."""
    shared = materialize(heads.groupBy("did").agg(F.count("*").alias("sets")).where("sets > 1"), "shareddid")
    if shared.isEmpty():
        return heads.withColumn("id", F.col("did"))
    marked = heads.join(shared, "did", "left")
    return materialize(marked.select(*heads.columns, F.when(F.col("sets").isNull(), F.col("did")).otherwise(F.xxhash64("d1", "d2", "n", "did")).alias("id")), "heads")


def _links(rows: DataFrame, heads: DataFrame, s: Setting) -> DataFrame:
    """``a, b``: confirmed links between heads, enough of them to join all that are linked."""
    pairs, long = candidates(heads, s)
    pairs = estimated(pairs, heads, s)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(long.select("id"))
    sets = sets_of(rows, heads, ids, s)
    known = confirmed(pairs, sets, s)
    if long.isEmpty():
        return known.where("linked").select("a", "b")
    open_ = long = materialize(long.join(heads.select("id", "copies"), "id"), "long")
    for done in range(s.rounds):
        # Members without a link to a centre so far elect the next one of their list; all members meet it.
        centre = open_.groupBy("v").agg(F.max_by(F.struct("id", "n", "bits"), F.struct("copies", F.negate("id"))).alias("c"))
        centre = materialize(_side(centre.select("v", "c.*"), 2), "centre")
        meet = _side(long, 1).join(centre, (F.col("v1") == F.col("v2")) & (F.col("id1") != F.col("id2")) & _may_link(s))
        known = known.union(confirmed(estimated(_untried(meet, known), heads, s), sets, s))
        linked = known.where("linked").select(F.col("a").alias("id"), F.col("b").alias("id2"))
        linked = linked.union(linked.select("id2", "id"))
        open_ = open_.join(centre.select(F.col("v2").alias("v"), "id2"), "v").where("id != id2").join(linked, ["id", "id2"], "left_anti").select(*long.columns)
        open_ = materialize(open_, "open")
        if open_.isEmpty():
            if done == 0:
                return known.where("linked").select("a", "b")
            # Each member has a centre, but members of two centres may be linked to each other.
            break
    links = known.where("linked").select("a", "b")
    # What the centres of a list have joined is one component; the members outside of it meet the whole list.
    members = materialize(long.select("v", "id").join(connected_components(links, long.select("id")), "id"), "members")
    most = members.groupBy("v", "component").agg(F.count("*").alias("size")).groupBy("v").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    members = materialize(members.join(most, "v").select("main", "id", "component").distinct(), "members")
    return links.union(blockwise_links(members.where("component != main"), members, sets, s))


def blockwise_links(queries: DataFrame, members: DataFrame, sets: DataFrame, s: Setting) -> DataFrame:
    """``a, b``: links from queries to members of the same main(main, id, component), one for each component that a query reaches.

    Both sides are dealt into blocks, and each block of queries meets each
    block of members in a task of its own, so a task holds a bounded number of
    sets whatever the size of a list; only links are returned.
    """
    both = [queries.groupBy("main").agg(F.ceil(F.count("*") / s.query_block).alias("xs")), members.groupBy("main").agg(F.ceil(F.count("*") / s.member_block).alias("ys"))]
    blocks_of = materialize(both[0].join(both[1], "main"), "blocks")

    def side(part: DataFrame, own: str, size: str, other: str, count: str) -> DataFrame:
        dealt = part.join(blocks_of, "main").withColumn(own, F.pmod(F.xxhash64("id"), F.col(size)))
        return dealt.join(sets, "id").select("main", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(other), "id", "component", "items")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = [np.frombuffer(i, np.uint64) for i in left["items"]]
        size = np.array([len(i) for i in x])
        items, owner = np.concatenate([*x, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(x)), size)
        order = np.argsort(items, kind="stable")
        items, owner, component = items[order], owner[order], left["component"].to_numpy()
        found: dict[tuple[int, int], int] = {}
        for i, c, y in zip(right["m_id"], right["m_component"], (np.frombuffer(y, np.uint64) for y in right["m_items"]), strict=True):
            low, high = np.searchsorted(items, y, "left"), np.searchsorted(items, y, "right")
            n = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
            common = np.bincount(owner[at], minlength=len(x))
            for k in np.flatnonzero((100 * common >= s.percent * (size + len(y) - common)) & (component != c)):
                found[int(k), int(c)] = min(int(i), found.get((int(k), int(c)), int(i)))
        ids = left["id"].to_numpy()
        pairs = sorted({(min(int(ids[k]), i), max(int(ids[k]), i)) for (k, _), i in found.items()})
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    left, right = side(queries, "x", "xs", "y", "ys"), side(members, "y", "ys", "x", "xs")
    right = right.select(*[F.col(c).alias(f"m_{c}") for c in right.columns])
    return materialize(left.groupBy("main", "x", "y").cogroup(right.groupBy("m_main", "m_x", "m_y")).applyInPandas(compare, "a long, b long").distinct(), "blocklinks")


def _untried(meet: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct pairs a < b of meet(id1, id2) that have not been judged yet."""
    pairs = meet.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
    return materialize(pairs.join(known, ["a", "b"], "left_anti"), "untried")


#: The query's contract: shingles of two words.
PAIRS_OF_WORDS = Setting(shingle=2)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), PAIRS_OF_WORDS)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
sym AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT sym.a, reach.r FROM sym JOIN reach ON sym.b = reach.id),
least AS (SELECT id AS doc_id, min(r) AS component FROM reach GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
