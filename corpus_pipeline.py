"""From raw documents to a training mix, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.decontaminate import decontaminate
from cairn.llm.line_dedup import line_dedup
from cairn.llm.mixing import mix
from cairn.llm.near_dedup import near_dedup
from cairn.llm.quality_rules import quality_rules
from cairn.llm.rows import identity
from cairn.session import materialize

ROW = ["did", "tkey"]


def _with_keys(docs: DataFrame) -> DataFrame:
    """docs as one struct column and the identity that the operators give its rows."""
    return docs.select(F.struct(*docs.columns).alias("doc"), *identity())


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    judged = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("q_kept").select("doc.*")


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut; a document left without a line stays, empty."""
    cut = line_dedup(docs).select(*ROW, "kept").dropDuplicates(ROW)
    joined = _with_keys(docs).join(cut, ROW)
    changed = {"text": F.when(F.col("doc.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("doc.text").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("kept").cast("long"))}
    return joined.select(*[changed.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) the smallest doc_id stays."""
    kept = near_dedup(docs).where("kept").select(*ROW).distinct()
    return _with_keys(docs).join(kept, ROW, "left_semi").select("doc.*")


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean = found.where(F.size("spans") == 0).select(*ROW).distinct()
    return _with_keys(docs).join(clean, ROW, "left_semi").select("doc.*")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken of each and its rounds."""
    taken = mix(docs).where("taken > 0")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", F.ceil(F.col("taken") / F.col("size")).alias("rounds"))


STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_lines),
    ("near_dedup", stage_near),
    ("benchmark_decontamination", stage_benchmark),
    ("mix_sources", stage_mix),
]

#: The learned rules and the shingle hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
