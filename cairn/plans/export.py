"""Result tables and their files."""

from __future__ import annotations

import csv
import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import EXPORT_COLUMNS
from ..functions.paths import basename, dirname, human_size, iso_time
from ..functions.ranks import numbered
from ..session import materialize


def flat_rows(groups: DataFrame, category: str, title: str) -> DataFrame:
    """The ten export columns from groups(group_id, path, size, mtime, role); groups are numbered by group_id."""
    # Both the numbers and the rows read the groups, which are far fewer than what they were found in.
    groups = materialize(groups.select("group_id", "path", "size", "mtime", "role"), "groups")
    keys = numbered(groups.select("group_id").distinct(), "group_id", "group")
    return _export_row(groups.join(keys, "group_id"), category, title)


def _export_row(rows: DataFrame, category: str, title: str) -> DataFrame:
    role = F.when(F.col("role") == "keep", "keeper").when(F.col("role").isin("move", "review"), F.col("role")).otherwise("item")
    out = rows.select(F.lit(category).alias("category"), F.lit(title).alias("category_title"), "group", role.alias("role"), "path", basename(F.col("path")).alias("name"), dirname(F.col("path")).alias("folder"), F.col("size").alias("size_bytes"), human_size(F.col("size")).alias("size_human"), iso_time(F.col("mtime")).alias("mtime_iso"))
    return out.select(*EXPORT_COLUMNS)


#: Categories in the order of a report; those that are no groups have one, number 0.
CATEGORIES = (
    ("dup", "Exact duplicates", True), ("name", "Name conflicts", True), ("ver", "Version anomalies", True), ("image", "Similar images", True),
    ("video", "Similar videos", True), ("audio", "Similar audio", True), ("doc", "Same text", True), ("docnear", "Near-identical documents", True),
    ("zip", "Same archives", True), ("archloose", "Unpacked archives", False), ("junk", "Junk files", False), ("empty", "Empty folders", False),
)


def all_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """The export rows of all given categories: groups(group_id, path, size, mtime, role), and for flat ones items(path, size, mtime)."""
    unknown = set(parts) - {key for key, _, _ in CATEGORIES}
    if unknown or not parts:
        raise ValueError(f"unknown categories: {sorted(unknown)}" if unknown else "no categories")
    out = None
    for key, title, grouped in CATEGORIES:
        if key not in parts:
            continue
        if grouped:
            rows = flat_rows(parts[key], key, title)
        else:
            items = parts[key].select(F.lit(0).alias("group_id"), "path", "size", "mtime", F.lit("move" if key == "junk" else "item").alias("role"))
            rows = _export_row(items.withColumn("group", F.lit(0)), key, title)
        out = rows if out is None else out.unionByName(rows)
    return out


def stats(counts: dict[str, DataFrame]) -> DataFrame:
    """One row of all counters: each of counts is a frame of one row with one number."""
    long = None
    for name, one in counts.items():
        row = one.select(F.lit(name).alias("name"), F.col(one.columns[0]).cast("long").alias("value"))
        long = row if long is None else long.unionByName(row)
    return long.agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in counts])


def sorted_groups(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Adds ``place``, the order within each group by size, date, folder or name; ties go by path."""
    column = {"size": "size_bytes", "date": "mtime_iso", "folder": "folder", "name": "name"}[key]
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("category", "group").orderBy(order, "path")))


def reset_selection(rows: DataFrame, how: str) -> DataFrame:
    """The selection as recommended, all but keepers, or none."""
    if how == "recommended":
        return prechecked(rows)
    if how not in ("all", "none"):
        raise ValueError(f"unknown selection: {how}")
    return rows.withColumn("prechecked", (F.col("role") != "keeper") if how == "all" else F.lit(False))


def write_csv_file(rows: DataFrame, path: str) -> int:
    """One csv file with header and byte order mark, written as rows arrive at the driver; returns their count."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file)
        out.writerow(EXPORT_COLUMNS)
        for r in rows.select(*EXPORT_COLUMNS).orderBy("category", "group", "path").toLocalIterator():
            out.writerow(["" if x is None else x for x in r])
            n += 1
    return n


def write_json_file(rows: DataFrame, counters: dict, path: str) -> int:
    """One json file {schema, generated_at, stats, categories: [{key, title, count, groups}]}, written group by group; returns the count of rows."""
    n = 0
    sizes = {r["category"]: r for r in rows.groupBy("category").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("rows")).collect()}
    head = {"schema": 1, "generated_at": datetime.now().isoformat(timespec="seconds"), "stats": counters}
    with open(path, "w", encoding="utf-8") as file:
        file.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "categories": [')
        for i, (key, title, grouped) in enumerate(CATEGORIES):
            count = sizes[key]["groups" if grouped else "rows"] if key in sizes else 0
            file.write((", " if i else "") + json.dumps({"key": key, "title": title, "count": count}, ensure_ascii=False)[:-1] + ', "groups": [')
            if key in sizes:
                for j, r in enumerate(nested_json(rows.where(F.col("category") == key)).orderBy("group").toLocalIterator()):
                    file.write((", " if j else "") + r["json"])
                n += sizes[key]["rows"]
            file.write("]}")
        file.write("]}")
    return n


def write_rows(rows: DataFrame, path: str, kind: str) -> None:
    """As csv with header, json or parquet, in parallel part files."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format: {kind}")
    rows.write.mode("overwrite").format(kind).options(**({"header": "true", "encoding": "UTF-8"} if kind == "csv" else {})).save(path)


def nested_json(rows: DataFrame) -> DataFrame:
    """category, json: one document for each group, its files sorted by path."""
    files = F.sort_array(F.collect_list(F.struct("path", "name", "size_bytes", "role")))
    return rows.groupBy("category", "group").agg(files.alias("files")).select("category", "group", F.to_json(F.struct("group", "files")).alias("json"))


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count_distinct("group").alias("n_groups"), F.count("*").alias("n_rows"))


def best_category(counts: DataFrame) -> DataFrame:
    """The category with most groups, junk and empty folders aside; ties go to the smaller name."""
    return counts.where("category not in ('junk', 'empty')").orderBy(F.desc("n_groups"), "category").limit(1)


def result_filter(rows: DataFrame, text: str, min_size: int) -> DataFrame:
    """Rows with the text in their path, whatever its case, and the size; groups keep their unfiltered count."""
    whole = rows.groupBy("category", "group").agg(F.count("*").alias("group_rows"))
    return rows.where(F.contains(F.lower("path"), F.lit(text.lower())) & (F.col("size_bytes") >= min_size)).join(whole, ["category", "group"])


def prechecked(rows: DataFrame) -> DataFrame:
    """Adds ``prechecked``: only exact duplicates to move and junk are."""
    return rows.withColumn("prechecked", ((F.col("category") == "dup") & (F.col("role") == "move")) | (F.col("category") == "junk"))


def selection_total(rows: DataFrame) -> DataFrame:
    return rows.where("prechecked").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def html_report(rows: list[dict], title: str) -> str:
    """A self-contained page for a bounded page of rows; '</' is escaped so that data cannot end the script."""
    data = json.dumps(rows, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><table id="t"></table><script>const rows={data};for(const r of rows){{const tr=document.getElementById("t").insertRow();for(const k in r)tr.insertCell().textContent=r[k];}}</script>'
