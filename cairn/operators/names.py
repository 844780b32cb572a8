"""Version families and anomalies of file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

FLAGS = "(?iU)"


def family(stem: Column, ext: Column) -> Column:
    """The name without version, date and copy tokens, with its extension; null if nothing is left."""
    s = stem
    for pattern, flags in ((fixed.DATE_TOKEN, "(?U)"), (fixed.VERSION_NUMBER, FLAGS), (fixed.PAREN_NUMBER, "(?U)"), (fixed.COPY_TOKEN, FLAGS), (fixed.TRAILING_NUMBER, "(?U)")):
        s = F.regexp_replace(s, flags + pattern, "")
    for word in fixed.FAMILY_KEYWORDS:
        s = F.regexp_replace(s, rf"{FLAGS}(?<=^|[ _\-.()\[\]]){word}(?=$|[ _\-.()\[\]])", "")
    s = F.lower(F.trim(F.regexp_replace(s, r"[ _\-.]+", " ")))
    return F.when(s != "", F.concat(s, F.lit("|"), ext))


def score(stem: Column, keywords: tuple[str, ...] = fixed.VERSION_KEYWORDS) -> Column:
    """How new a name claims to be: struct(date, keyword, number, copies), compared in this order."""
    low = F.lower(stem)
    numbers = [F.transform(F.regexp_extract_all(stem, F.lit(flags + p), F.lit(1)), lambda x: x.cast("int")) for p, flags in ((fixed.VERSION_NUMBER, FLAGS), (fixed.PAREN_NUMBER, "(?U)"), (fixed.TRAILING_NUMBER, "(?U)"))]
    date = F.regexp_extract(stem, "(?U)" + fixed.DATE_TOKEN, 0)
    return F.struct(
        F.when(date == "", 0).otherwise(F.regexp_replace(date, "[^0-9]", "").try_cast("int")).alias("date"),
        F.greatest(*[F.when(F.contains(low, F.lit(word.lower())), i).otherwise(-1) for i, word in enumerate(keywords)]).alias("keyword"),
        F.greatest(F.lit(0), F.coalesce(F.array_max(F.concat(*numbers)), F.lit(0))).alias("number"),
        F.size(F.regexp_extract_all(stem, F.lit(FLAGS + fixed.COPY_TOKEN), F.lit(0))).alias("copies"),
    )


def version_anomalies(files: DataFrame) -> DataFrame:
    """Families whose newest name and newest file differ, from files(path, stem, ext, mtime, key).

    family, path, claimed_latest, mtime_latest, tags; ties go to the smaller path.
    """
    scored = files.withColumn("family", family(F.col("stem"), F.col("ext"))).where("family is not null").withColumn("score", score(F.col("stem")))
    # max_by over a struct whose last part orders paths downwards: count first, then pick by least path.
    best = scored.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("key").alias("contents"), F.count_distinct("score").alias("scores"), F.max("score").alias("top_score"), F.max(F.coalesce("mtime", F.lit(0.0))).alias("top_time"))
    best = best.where("n > 1 and contents > 1 and scores > 1")
    joined = scored.join(best, "family")
    picks = joined.groupBy("family").agg(F.min(F.when(F.col("score") == F.col("top_score"), F.col("path"))).alias("claimed_latest"), F.min(F.when(F.coalesce("mtime", F.lit(0.0)) == F.col("top_time"), F.col("path"))).alias("mtime_latest"))
    out = joined.join(picks.where("claimed_latest <> mtime_latest"), "family")
    tags = F.array_compact(F.array(F.when(F.col("path") == F.col("claimed_latest"), "claimed_latest"), F.when(F.col("path") == F.col("mtime_latest"), "mtime_latest")))
    return out.select("family", "path", "claimed_latest", "mtime_latest", tags.alias("tags"))
