"""All categories of a report from a stored catalog and its fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import extension, stem
from ..operators import archives, audio, bits, groups, names, similar
from ..session import materialize


def by_name(files: DataFrame) -> dict[str, DataFrame]:
    """Exact duplicates, name conflicts and version anomalies of files(path, name, size, mtime, full_hash)."""
    known = files.withColumn("key", groups.content_key(F.col("full_hash"), F.col("path"))).withColumn("stem", stem(F.col("name"))).withColumn("ext", extension(F.col("name")))
    conflicts = groups.name_conflicts(known).withColumnRenamed("lower_name", "group_id")
    versions = names.version_anomalies(known).select(F.col("family").alias("group_id"), "path", F.lit("review").alias("role"))
    return {"dup": groups.exact_duplicates(files), "name": _placed(conflicts, files), "ver": _placed(versions, files)}


def by_fingerprint(files: DataFrame, prints: DataFrame, loose_images: bool = False) -> dict[str, DataFrame]:
    """Groups of files whose prints(path, img, vid, aud, txt, txtmin, zipf) are equal or near, but not their contents.

    Images are grouped by equal prints, or with ``loose_images`` by near ones.
    A near-document group needs two different texts. Files without print are in no group.
    """
    known = files.join(prints.select("path", "img", "vid", "aud", "txt", "txtmin", "zipf"), "path")
    known = materialize(known.withColumn("key", groups.content_key(F.col("full_hash"), F.col("path"))), "printed")
    out = {"doc": groups.same_fingerprint(known, "txt"), "zip": groups.same_fingerprint(known, "zipf")}
    signed = known.where("txtmin is not null").select("path", F.col("txtmin").alias("sig"))
    out["docnear"] = groups.labelled_groups(known, similar.near_clusters(signed, fixed.TEXT_NEAR_THRESHOLD), "txt")
    if loose_images:
        out["image"] = _clustered(known, bits.clusters(known.select(F.col("path").alias("id"), F.col("img").alias("words")), fixed.IMAGE_THRESHOLD))
    else:
        out["image"] = groups.same_fingerprint(known, "img")
    frames = known.select(F.col("path").alias("id"), bits.hex_words(F.col("vid")).alias("words"))
    out["video"] = _clustered(known, bits.clusters(frames, fixed.VIDEO_THRESHOLD))
    out["audio"] = _clustered(known, audio.audio_clusters(known.select(F.col("path").alias("id"), F.col("aud").alias("print"))))
    return {key: _placed(group, files) for key, group in out.items()}


def unpacked(files: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """Archives all of whose entries(archive, name, size, crc) lie in the catalog as files."""
    found = archives.unpacked_archives(entries.withColumn("name", F.substring_index("name", "/", -1)), files)
    return {"archloose": files.join(found.select(F.col("archive").alias("path")), "path", "left_semi")}


def _clustered(files: DataFrame, labels: DataFrame) -> DataFrame:
    return groups.labelled_groups(files, labels.select(F.col("id").alias("path"), "component"))


def _placed(group: DataFrame, files: DataFrame) -> DataFrame:
    """group_id, path, size, mtime, role: the export reads these."""
    return group.select("group_id", "path", "role").join(files.select("path", "size", "mtime"), "path")
