"""One pass of fingerprints over a catalog, each file by the readers its format has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import ship
from . import similar, textnorm
from .archives import manifest_hashes

IMAGE, RAW, TEXT, ARCHIVE, VIDEO, AUDIO = "image", "raw", "text", "archive", "video", "audio"
#: Formats whose readers decode whole media; they get partitions of their own size.
HEAVY = (RAW, VIDEO, AUDIO)


def route(ext: Column) -> Column:
    """What a file's fingerprint is made of, by its extension; null if there is none."""
    return (
        F.when(ext.isin(*fixed.IMAGE_EXTS), IMAGE)
        .when(ext.isin(*fixed.RAW_EXTS), RAW)
        .when(ext.isin(*fixed.DOCZIP_EXTS, *fixed.PDF_EXTS, *fixed.HWP_EXTS, *fixed.PLAINTEXT_EXTS), TEXT)
        .when(ext.isin(*fixed.ZIP_EXTS, *fixed.SEVENZIP_EXTS), ARCHIVE)
        .when(ext.isin(*fixed.VIDEO_EXTS), VIDEO)
        .when(ext.isin(*fixed.AUDIO_EXTS), AUDIO)
    )


def routed(files: DataFrame, media: bool = True) -> DataFrame:
    """files with ``route`` and ``heavy``; without media, heavy files are left out."""
    out = files.withColumn("route", route(F.col("ext"))).where("route is not null")
    out = out.withColumn("heavy", F.col("route").isin(*HEAVY))
    return out if media else out.where("not heavy")


def fingerprints(files: DataFrame, images: DataFrame | None = None, media: DataFrame | None = None) -> DataFrame:
    """path, size, mtime, img, vid, aud, txt, txtmin, zipf for files(path, ext, size, mtime, content) with a format that has any.

    Texts and archives are read in one pass over their content. ``images`` may
    bring path, img of decoded images, ``media`` path, vid, aud of decoded
    videos and audio. What cannot be read stays null.
    """
    ship(files.sparkSession)
    known = routed(files)
    texts = known.where(F.col("route") == TEXT).select("path", textnorm.normalize(textnorm.extract_text("content", "ext")).alias("normal"))
    signed = similar.signatures(texts.where("normal is not null")).withColumnRenamed("sig", "txtmin")
    texts = texts.select("path", textnorm.text_hash(F.col("normal")).alias("txt")).join(signed, "path", "left")
    packed = manifest_hashes(entries(files)).select(F.col("archive").alias("path"), F.col("manifest").alias("zipf"))
    out = known.select("path", "size", "mtime").join(texts, "path", "left").join(packed, "path", "left")
    for more, kinds in ((images, {"img": "array<bigint>"}), (media, {"vid": "string", "aud": "string"})):
        if more is None:
            out = out.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})
        else:
            out = out.join(more.select("path", *kinds), "path", "left")
    return out.select("path", "size", "mtime", "img", "vid", "aud", "txt", "txtmin", "zipf")


def entries(files: DataFrame) -> DataFrame:
    """archive, name, size, crc of the entries of all archives among files(path, ext, content)."""
    from ..sources.files import sevenzip_entries, zip_entries

    listed = F.when(F.col("ext").isin(*fixed.SEVENZIP_EXTS), sevenzip_entries("content")).otherwise(zip_entries("content"))
    return routed(files).where(F.col("route") == ARCHIVE).select(F.col("path").alias("archive"), F.explode(listed).alias("e")).select("archive", "e.*")
