"""Quality rules: learned decision lists over text statistics.

Statistics are DataFrame expressions. A decision list is grown by sequential
covering on labelled statistics: conditions "statistic above (or below) a
threshold" are joined into a conjunction while its information gain grows, the
conjunction is pruned on held-back rows, the rows it covers are set aside, and
the next rule is grown on what is left. The finished list is one ordered Spark
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import BLANK_CHARS, n_words

MIN_WORDS = 50
#: Labelled rows that a list is learned from at most; of more, those with the smallest hash of their doc_id.
FIT_ROWS = 20_000
THRESHOLDS = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
#: A rule must be this sure, on the rows held back as on the others, that what it rejects is bad.
MIN_PRECISION = 0.97

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_lines_per_line", "repeat_words", "upper_share", "bang_per_word", "distinct_share")


def _times(text: Column, chars: str) -> Column:
    """Characters of the text that are in chars."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda variable is bound to it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more in the array, the first occurrence included.

    Windows are sorted by (hash, position); neighbours with equal words mark
    each other, and the marked positions, sorted again, are counted without
    overlap: a window adds 3 words, or as many as lie before the next mark.
    Most texts repeat no window, which a primitive sort of the hashes tells first.
    """

    def count(w: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), windows)

    def windows(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, marked))

    def marked(s: Column) -> Column:
        same = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def covered(marks: Column) -> Column:
        return F.aggregate(F.transform(marks, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(marks, j + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda total, x: total + x)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(w, count))


def with_statistics(rows: DataFrame) -> DataFrame:
    """rows, which have a ``text`` and no column named q or q_..., with a struct column ``q``: base counts and the features of the rules."""
    body = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANK_CHARS))
    w = F.when(F.char_length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.char_length(F.btrim(x, F.lit(BLANK_CHARS))) > 0)
    first = rows.withColumn("q_words", w).withColumn("q_lines", lines)
    words = F.col("q_words")
    made = first.withColumn(
        "q",
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.translate(body, BLANK_CHARS, "")).cast("long").alias("word_chars"),
            _times(body, SYMBOLS).alias("n_symbols"),
            (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            F.size("q_lines").cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            _times(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            _times(body, "!").alias("n_bangs"),
        ),
    )
    return made.drop("q_words", "q_lines")


def features(q: Column) -> dict[str, Column]:
    """Comparable statistics of a text, all doubles, 0 for an empty one."""
    per = lambda a, b: F.when(q[b] > 0, q[a] / q[b]).otherwise(0.0).cast("double")
    return {
        "n_words": q["n_words"].cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "bang_per_word": per("n_bangs", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which all conditions hold."""

    conditions: tuple[Condition, ...]


def fit(rows: list[tuple[list[float], bool, bool]], names: tuple[str, ...] = FEATURES) -> list[Rule]:
    """A decision list from rows (features, bad, held back). Sets of rows are kept as the bits of integers."""
    if not rows:
        return []
    every, bad, prune = (sum(1 << i for i, r in enumerate(rows) if f(r)) for f in (lambda r: True, lambda r: r[1], lambda r: r[2]))
    tests: list[tuple[Condition, int]] = []
    for k, name in enumerate(names):
        column = [r[0][k] for r in rows]
        ranked = sorted(set(column))
        steps = sorted({ranked[len(ranked) * j // (THRESHOLDS + 1)] for j in range(1, THRESHOLDS + 1)} | {x for j in range(1, THRESHOLDS + 1) for x in [sorted(column)[len(column) * j // (THRESHOLDS + 1)]]})
        for t in steps:
            over = sum(1 << i for i, x in enumerate(column) if x > t)
            tests += [(Condition(name, True, t), over), (Condition(name, False, t), every & ~over)]
    left, rules = every, []
    for _ in range(MAX_RULES):
        grow = left & ~prune
        covered, conditions = grow, []
        while len(conditions) < MAX_CONDITIONS:
            p0, n0 = (covered & bad).bit_count(), covered.bit_count()
            if not p0 or p0 == n0:
                break
            before = math.log2(p0 / n0)
            best = max(tests, key=lambda t: (_gain(covered & t[1], bad, before), t[0].feature, t[0].above, t[0].threshold))
            if _gain(covered & best[1], bad, before) <= 0:
                break
            conditions.append(best)
            covered &= best[1]
        held = left & prune
        # Drop last conditions while the held-back rows judge the rest no worse.
        best_n = max(range(1, len(conditions) + 1), key=lambda n: (_worth(held, conditions[:n], bad), -n), default=0)
        conditions = conditions[:best_n]
        found = left
        for _, mask in conditions:
            found &= mask
        if not conditions or min(_precision(found & ~prune, bad), _precision(found & prune, bad)) < MIN_PRECISION or (found & bad).bit_count() < max(3, len(rows) // 2000):
            break
        rules.append(Rule(tuple(c for c, _ in conditions)))
        left &= ~found
    return rules


def _gain(covered: int, bad: int, before: float) -> float:
    p, n = (covered & bad).bit_count(), covered.bit_count()
    return p * (math.log2(p / n) - before) if p else -1.0


def _worth(held: int, conditions: list, bad: int) -> float:
    for _, mask in conditions:
        held &= mask
    p, n = (held & bad).bit_count(), held.bit_count()
    return (2 * p - n) / n if n else -1.0


def _precision(found: int, bad: int) -> float:
    return (found & bad).bit_count() / found.bit_count() if found else 1.0


def verdict(rules: list[Rule], q: Column) -> Column:
    """0 if no rule fires, else the number of the first that does: one ordered conditional expression."""
    have = features(q)
    out = None
    for number, rule in enumerate(rules, 1):
        fires = F.lit(True)
        for c in rule.conditions:
            fires = fires & ((have[c.feature] > c.threshold) if c.above else (have[c.feature] <= c.threshold))
        out = F.when(fires, number) if out is None else out.when(fires, number)
    return F.lit(0) if out is None else out.otherwise(0)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Fit on documents with a quality label (0 is bad), at most ``fit_rows`` of them, chosen by a hash of doc_id.

    A fifth of them, by the same hash, is held back for pruning. The sample is
    fixed by the bound alone, so the driver's share does not grow with the data.
    """
    key = F.xxhash64("doc_id")
    labelled = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labelled = labelled.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("key", key).orderBy("key", "doc_id").limit(fit_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(labelled), "doc_id")
    sample = with_statistics(sample)
    have = features(F.col("q"))
    judged = F.struct(*[have[k].alias(k) for k in FEATURES], base_failed(F.col("q")).alias("failed"))
    # Of rows that repeat a doc_id one counts, so the labels bound what is collected.
    sample = sample.groupBy("key", "doc_id", "quality").agg(F.min(judged).alias("s"))
    rows = sample.select("s.*", (F.col("quality") == 0).alias("bad"), (F.pmod("key", F.lit(5)) == 0).alias("held"), "key", "doc_id").collect()
    # Sorted out here: as a filter it would move below the join, and statistics of every document be made for it.
    rows = [r for r in rows if not r["failed"]]
    rows.sort(key=lambda r: (r["key"], r["doc_id"], *r[: len(FEATURES)]))
    return fit([(list(r[: len(FEATURES)]), r["bad"], r["held"]) for r in rows])


def quality_rules(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``doc`` (a struct of all columns of docs), ``q`` (statistics), ``q_base_failed``, ``q_rule`` (number of the rule that rejects, or 0) and ``q_kept``.

    A text fails at once with fewer than 50 words or if more than half of its
    words lie in repeated 3-word windows. The others are judged by ``rules``,
    or by a list learned from labels(doc_id, quality).

    Null, empty and blank texts have 0 in all statistics and fail. Documents
    without label, with a null doc_id or in repeated rows are judged like any
    other; a doc_id labelled twice is bad if one label says so, and of rows that
    repeat a labelled doc_id the one with the least statistics is learned from.
    Without labels there are no rules. An empty table gives an empty table.
    Columns of docs are within the struct, so none can clash.
    """
    rules = learn(docs, labels) if rules is None else rules
    out = with_statistics(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("string").alias("text")))
    return out.select("doc", "q", base_failed(F.col("q")).alias("q_base_failed"), verdict(rules, F.col("q")).alias("q_rule")).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_rule") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc.doc_id", *[F.col("q")[k].alias(k) for k in names], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_rule").alias("rule"))
