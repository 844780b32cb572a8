"""Command line: scan, report, export, apply, undo and doctor over a store folder."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import basename
from .operators import catalog, fingerprints, groups, hashing
from .plans import apply, categories, export, moves
from .plans.doctor import doctor
from .session import local_session
from .sources.files import decisions, file_tree
from .sources.images import image_prints
from .sources.media_tools import media_prints


def _catalog(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/catalog")


def _rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Export rows of all categories that the last scan allows."""
    files = _catalog(spark, args.store)
    parts = categories.by_name(files) | {"junk": spark.read.parquet(f"{args.store}/junk")}
    if args.fingerprints:
        parts |= categories.by_fingerprint(files, spark.read.parquet(f"{args.store}/prints"), args.loose_images)
        parts |= categories.unpacked(files, spark.read.parquet(f"{args.store}/entries"))
    return export.all_rows(parts)


def _plain(path: str = "path") -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    """Catalog, junk and hashes; the old catalog stays until the new one is whole."""
    listed = file_tree(spark, args.roots).withColumn("path", _plain())
    split = catalog.split_junk(catalog.outside_quarantine(listed, args.quarantine))
    kept = catalog.at_least(catalog.exclude(split.where("not junk").drop("junk")), args.min_size)
    hashed = hashing.staged_hashes(kept).drop("content")
    hashed.withColumn("name", basename(F.col("path"))).write.mode("overwrite").parquet(f"{args.store}/catalog.new")
    if args.fingerprints:
        images = image_prints(spark, args.roots).withColumn("path", _plain())
        made = fingerprints.fingerprints(kept, images, media_prints(fingerprints.routed(kept)))
        made.write.mode("overwrite").parquet(f"{args.store}/prints")
        fingerprints.entries(kept).write.mode("overwrite").parquet(f"{args.store}/entries")
    split.where("junk").select("path", "name", "size", "mtime").write.mode("overwrite").parquet(f"{args.store}/junk")
    spark.read.parquet(f"{args.store}/catalog.new").write.mode("overwrite").parquet(f"{args.store}/catalog")
    print(f"{_catalog(spark, args.store).count()} files")
    return 0


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    """An HTML page of the first rows."""
    page = [r.asDict() for r in _rows(spark, args).orderBy("category", "group", "path").limit(args.rows).collect()]
    with open(args.out, "w", encoding="utf-8") as out:
        out.write(export.html_report(page, "cairn"))
    return 0


def write(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = _rows(spark, args)
    if args.format == "csv":
        n = export.write_csv_file(rows, args.out)
    else:
        files = _catalog(spark, args.store)
        stats = files.agg(F.count("*").alias("total_files")).first().asDict() | {"reclaimable_bytes": groups.reclaimable(groups.exact_duplicates(files)).first()["bytes"]}
        n = export.write_json_file(rows, stats, args.out)
    print(f"{n} rows in {args.out}")
    return 0


def move(spark: SparkSession, args: argparse.Namespace) -> int:
    """Moves of a decisions file, or of all recommended ones; a dry run unless --apply."""
    chosen = decisions(spark, args.decisions).select("path") if args.decisions else groups.exact_duplicates(_catalog(spark, args.store)).where("role = 'move'").select("path")
    stamp = args.stamp or time.strftime("%Y%m%d_%H%M%S")
    manifest = apply.apply_moves(moves.move_plan(chosen, args.quarantine, stamp), not args.apply)
    if args.apply:
        manifest.write.parquet(f"{args.store}/undo_{stamp}")
        manifest = spark.read.parquet(f"{args.store}/undo_{stamp}")
    for r in manifest.groupBy("status").count().orderBy("status").collect():
        print(r["status"], r["count"])
    print(stamp)
    return 0


def undo(spark: SparkSession, args: argparse.Namespace) -> int:
    back = apply.undo_moves(spark.read.parquet(f"{args.store}/undo_{args.stamp}"), dry_run=False)
    for r in back.groupBy("status").count().orderBy("status").collect():
        print(r["status"], r["count"])
    return 0


def probe(spark: SparkSession, args: argparse.Namespace) -> int:
    doctor(spark).show(100, truncate=False)
    return 0


def _print_options(command: argparse.ArgumentParser) -> None:
    command.add_argument("--fingerprints", action="store_true", help="also the categories by fingerprint; the scan must have made them")
    command.add_argument("--loose-images", action="store_true", help="group images by near prints, not by equal ones")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairn", description="Catalog files, find what is redundant, move it reversibly.")
    out.add_argument("--store", default="cairn-store", help="folder of catalogs and manifests")
    out.add_argument("--quarantine", default="cairn-quarantine", help="folder that moved files go to")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="list and hash the files below the roots")
    one.add_argument("roots", nargs="+")
    one.add_argument("--min-size", type=int, default=catalog.fixed.MIN_SIZE_BYTES)
    one.add_argument("--fingerprints", action="store_true", help="also read texts, archives, images, videos and audio")
    one.set_defaults(run=scan)
    one = commands.add_parser("report", help="HTML page")
    one.add_argument("--out", default="cairn-report.html")
    one.add_argument("--rows", type=int, default=5000)
    _print_options(one)
    one.set_defaults(run=report)
    one = commands.add_parser("export", help="all categories as csv or json")
    one.add_argument("--format", choices=("csv", "json"), default="csv")
    one.add_argument("--out", required=True)
    _print_options(one)
    one.set_defaults(run=write)
    one = commands.add_parser("apply", help="move files; a dry run unless --apply")
    one.add_argument("--apply", action="store_true")
    one.add_argument("--decisions")
    one.add_argument("--stamp")
    one.set_defaults(run=move)
    one = commands.add_parser("undo", help="move back")
    one.add_argument("stamp")
    one.set_defaults(run=undo)
    commands.add_parser("doctor", help="optional readers").set_defaults(run=probe)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    return args.run(spark or local_session(), args)


if __name__ == "__main__":
    sys.exit(main())
