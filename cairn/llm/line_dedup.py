"""Line dedup against levelled sorted runs of line hashes.

A run is a table of (key, first document) sorted by key, written once. Batches
of documents arrive in doc_id order: the keys of a batch are anti-joined with
every run, what is new becomes a run of level 0, and whenever a level holds
``fan_out`` runs they are merged into one run of the next level. A key's owner
is thus the smallest document that ever held it.

Runs are bucketed by key and sorted within their buckets, so anti-joins and
merges read them in place: only the keys of a batch are shuffled, once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let
from ..session import materialize, release, scratch_root
from .rows import NULL_IDS, heavy_keys, join_heavy, keyed

BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
BATCHES, FAN_OUT = 4, 2


class LineRuns:
    """The levelled runs: each a DataFrame k1, k2, owner with distinct keys, sorted within its files."""

    def __init__(self, fan_out: int = FAN_OUT):
        self.fan_out = fan_out
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def owners(self) -> DataFrame | None:
        """All runs as one table; their keys do not overlap."""
        out = None
        for run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge-anti-join keys(k1, k2, owner), distinct, with each run; what is new becomes a run and is returned."""
        for run in self.runs:
            keys = keys.join(run.select("k1", "k2"), ["k1", "k2"], "left_anti")
        new = write_run(keys.select("k1", "k2", "owner"))
        self._put(0, new)
        return new

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            parts, self.levels[level] = self.levels[level], []
            merged = parts[0]
            for other in parts[1:]:
                # Keys of two runs never meet, so the full join of their sorted buckets is their merge.
                both = merged.join(other.withColumnRenamed("owner", "later"), ["k1", "k2"], "full")
                merged = both.select("k1", "k2", F.coalesce("owner", "later").alias("owner"))
            self._put(level + 1, write_run(merged))
            drop_runs(parts)

    def drop(self) -> None:
        """Delete all runs."""
        drop_runs(self.runs)
        self.levels = []


def write_run(keys: DataFrame) -> DataFrame:
    """keys as a table in the shared folder, in as many buckets of (k1, k2) as a shuffle has partitions, each sorted."""
    spark = keys.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cairn_run_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    dealt = keys.repartition(buckets, "k1", "k2")
    dealt.write.format("parquet").bucketBy(buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name)
    run = spark.table(name)
    run._cairn_path, run._cairn_table = path, name
    return run


def drop_runs(runs: list[DataFrame]) -> None:
    for run in runs:
        run.sparkSession.sql(f"DROP TABLE IF EXISTS {run._cairn_table}")
    release(*runs)


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANK_CHARS))


def key_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """``did, tkey, pos, k1, k2``: each line with a key long enough, its key as two 64-bit hashes."""
    lines = rows.select("did", "tkey", F.posexplode(F.transform(line_array(F.col("text")), line_key)).alias("pos", "k"))
    return lines.where(F.char_length("k") >= min_chars).select("did", "tkey", "pos", F.xxhash64("k").alias("k1"), F.xxhash64(F.lit(1), "k").alias("k2"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """``doc_id, did, tkey, n_lines, dropped, kept`` for each row of docs(doc_id, text).

    Lines are split at newlines. A line's key is the line without blanks at its
    ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that two
    documents hold lose all lines but those of the smallest doc_id. dropped
    holds the positions (from 0) of lines that go, kept the other lines, joined
    by newlines; if no line is left it is empty.

    ``runs`` may bring the keys of earlier batches; their documents then own
    what they hold, and the keys of docs are added.

    A null or empty text is one empty line. Rows with one doc_id are one
    document: their lines are no repeats of each other, and each keeps them.
    Rows without doc_id are one document for each text, before all others. An empty table gives an empty
    table. Other columns are ignored.
    """
    rows = keyed(docs)
    held = materialize(key_rows(rows, min_chars), "linekeys")
    own, runs = runs is None, LineRuns() if runs is None else runs
    for batch in _batches(rows, held, batches):
        runs.add(batch.groupBy("k1", "k2").agg(F.min("did").alias("owner")))
    owners = runs.owners()
    foreign = held if owners is None else join_heavy(held, owners, ["k1", "k2"], heavy_keys(held, ["k1", "k2"])).where("owner < did")
    # Only the lines that a document loses are gathered, and they are bounded by its text.
    lost = foreign.groupBy("did", "tkey").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    lost = materialize(lost, "lostlines")
    if own:
        runs.drop()
    release(held)
    joined = rows.join(lost, ["did", "tkey"], "left")
    lines = line_array(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(let(lines, lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n")))
    dropped = F.coalesce("lost", F.array().cast("array<int>"))
    return joined.select("doc_id", "did", "tkey", F.size(lines).cast("long").alias("n_lines"), dropped.alias("dropped"), kept.alias("kept"))


def _batches(rows: DataFrame, held: DataFrame, batches: int) -> list[DataFrame]:
    """The key rows by doc_id ranges, in order."""
    low, high = rows.agg(F.min(F.when(F.col("did") >= NULL_IDS, F.col("did"))), F.max("did")).first()
    if low is None or batches == 1:
        return [held]
    width = (high - low) // batches + 1
    out = []
    for i in range(batches):
        # Bounds, not differences: rows without doc_id lie far below the others.
        part = held.where(F.col("did") >= low + i * width) if i else held
        out.append(part.where(F.col("did") < low + (i + 1) * width) if i + 1 < batches else part)
    return out


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line,
    trim(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT lines.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM lines LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
