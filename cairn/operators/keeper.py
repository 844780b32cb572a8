"""Which file of a group to keep."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import basename, depth, stem


def penalty(path: Column) -> Column:
    """100 for a word of temporary places anywhere in the path, 50 for a stem that looks like a copy."""
    place = F.lower(path).rlike("|".join(re.escape(w) for w in fixed.PENALTY_WORDS))
    copy = stem(basename(path)).rlike(f"(?iU){fixed.COPY_STEM}")
    return F.when(place, 100).otherwise(0) + F.when(copy, 50).otherwise(0)


def rank(path: Column, mtime: Column) -> Column:
    """Smallest is kept: penalty, depth, age (null oldest), length, then the path itself."""
    return F.struct(penalty(path).alias("p"), depth(path).alias("d"), F.coalesce(mtime, F.lit(0.0)).alias("m"), F.char_length(path).alias("l"), path.alias("path"))


def keeper(path: str = "path", mtime: str = "mtime") -> Column:
    """Aggregate: the path to keep."""
    return F.min_by(path, rank(F.col(path), F.col(mtime)))
