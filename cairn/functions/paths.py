"""Path, name and glob expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(slashed(path), "/[^/]*$", "")


def extension(name: Column) -> Column:
    """Lower-cased extension; names that only start with dots have none."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    ext = F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.substr(name, F.lit(1), F.char_length(name) - F.char_length(ext))


def glob_match(name: Column, globs: tuple[str, ...]) -> Column:
    """Whether the lower-cased name fits any shell pattern."""
    if not globs:
        return F.lit(False)
    return F.lower(name).rlike("|".join(fnmatch.translate(g.lower()).replace(r"\Z", r"\z") for g in globs))


def in_directory(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder on the path has one of the names, whatever its case."""
    parts = F.slice(F.split(F.lower(slashed(path)), "/"), F.lit(1), F.greatest(F.size(F.split(slashed(path), "/")) - 1, F.lit(0)))
    return F.exists(parts, lambda p: p.isin([n.lower() for n in names]))


def depth(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(slashed(path), F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """Every folder above the path, from the root's first name on; the root itself is ''."""
    parts = F.split(slashed(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def human_size(size: Column) -> Column:
    out = F.concat(F.format_string("%.0f", size.cast("double")), F.lit("B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", F.bround(size.cast("double") / 1024**power, 1)), F.lit(unit))).otherwise(out)
    return out


def iso_time(mtime: Column) -> Column:
    """Seconds to local ISO time; null is ''."""
    return F.coalesce(F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
