"""Carrying out move plans on a file system that all executors share.

Each file is moved by a task; an error concerns its file alone and becomes its
row of the manifest. A task that runs again finds its files where it left them,
so lost executors do no harm.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship


def move_one(src: str, dest: str) -> tuple[str, str]:
    """(status, error): moved, missing, occupied or failed."""
    try:
        if not os.path.lexists(src):
            return ("moved", "") if os.path.lexists(dest) else ("missing", "source is gone")
        if os.path.lexists(dest):
            return "occupied", "target exists"
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        shutil.move(src, dest)
        return "moved", ""
    except OSError as error:
        return "failed", str(error)


def apply_moves(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """The manifest src, dest, status, error of plan(src, dest); a dry run moves nothing and says ``planned``."""
    pairs = plan.select("src", "dest")
    if dry_run:
        return pairs.select("src", "dest", F.lit("planned").alias("status"), F.lit("").alias("error"))
    ship(plan.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [move_one(s, d) for s, d in zip(frame["src"], frame["dest"], strict=True)]
            yield frame.assign(status=[s for s, _ in done], error=[e for _, e in done])

    # The plan is fixed first: what it was made from may change as files move.
    return materialize(materialize(pairs, "plan").mapInPandas(run, "src string, dest string, status string, error string"), "manifest")


def undo_moves(manifest: DataFrame, dry_run: bool = True) -> DataFrame:
    """The manifest of moving back what a manifest says was moved."""
    return apply_moves(manifest.where("status = 'moved'").select(F.col("dest").alias("src"), F.col("src").alias("dest")), dry_run)


def purge(folders: DataFrame, root: str, trash: str, dry_run: bool = True) -> DataFrame:
    """Quarantine folders (folder, from ``moves.purge_preview``) go to the trash folder whole; nothing is deleted."""
    at = lambda base: F.concat(F.lit(base.rstrip("/") + "/"), "folder")
    return apply_moves(folders.select(at(root).alias("src"), at(trash).alias("dest")), dry_run)
