"""Fixtures of the catalog operators on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn import queries
from cairn.functions.paths import basename, extension, glob_match, human_size, in_directory
from cairn.operators import archives, bits, catalog, dirs, groups, hashing, incremental, insights, keeper, media, names, sequences, similar, textnorm
from cairn.operators.components import connected_components
from cairn.plans import export, moves

FILE = "path string, size long, mtime double, content string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths(spark):
    df = spark.createDataFrame([("C:\\a\\B.TXT",), ("/x/.hidden",), ("/x/a.tar.gz",), ("/x/none",)], "p string")
    assert [r[0] for r in df.select(extension(basename(F.col("p")))).collect()] == [".txt", "", ".gz", ""]
    assert [r[0] for r in df.select(glob_match(basename(F.col("p")), ("b.*",))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(in_directory(F.col("p"), ("A",))).collect()] == [True, False, False, False]
    sizes = spark.createDataFrame([(0,), (1024,), (1280,), (3 * 1024**4,)], "n long").select(human_size(F.col("n")))
    assert [r[0] for r in sizes.collect()] == ["0B", "1.0KB", "1.2KB", "3.0TB"]


def test_exact_duplicates_and_keeper(spark):
    same, edge = "A" * 200, "B" * 70_000
    data = [("/a/b/r1.bin", 200, 9.0, same), ("/r.bin", 200, 5.0, same), ("/a/b/c/x.bin", 200, 1.0, same), ("/z1", 0, 0.0, ""), ("/z2", 0, 0.0, ""), ("/e1", 70_000, 1.0, edge), ("/e2", 70_000, 1.0, edge[:-1] + "C")]
    hashed = hashing.staged_hashes(spark.createDataFrame(data, FILE))
    out = groups.exact_duplicates(hashed)
    assert [(r.path, r.role) for r in out.orderBy("path").collect()] == [("/a/b/c/x.bin", "move"), ("/a/b/r1.bin", "move"), ("/r.bin", "keep")]
    assert rows(groups.reclaimable(out)) == [(1, 2, 400)]
    # Equal heads below 128 KB: only the full hash tells them apart.
    assert hashed.where("path like '/e%'").select("full_hash").distinct().count() == 2
    assert hashed.where("path = '/r.bin'").first()["full_hash"] is not None
    assert rows(groups.reclaimable(groups.exact_duplicates(hashed.limit(0)))) == [(0, 0, 0)]


def test_name_conflicts(spark):
    df = spark.createDataFrame([("/A/Report.PDF", "Report.PDF", "h:1"), ("/B/report.pdf", "report.pdf", "h:2"), ("/C/one.txt", "one.txt", "h:3"), ("/D/one.txt", "one.txt", "h:3")], "path string, name string, key string")
    assert rows(groups.name_conflicts(df).select("path", "contents")) == [("/A/Report.PDF", 2), ("/B/report.pdf", 2)]


@pytest.mark.parametrize(
    ("members", "expected"),
    [
        ([("proposal_v1", 1, "a"), ("proposal_최종", 30, "b")], 2),
        ([("proposal v1", 1, "a"), ("proposal_최종", 30, "b")], 2),
        ([("doc v1", 30, "a"), ("doc v2", 1, "b")], 0),
        ([("자료", 1, "a"), ("원본자료", 30, "b")], 0),
        ([("memo v1", 1, "a"), ("memo_최종", 30, "a")], 0),
    ],
)
def test_version_anomalies(spark, members, expected):
    data = [(f"/{s}.docx", s, ".docx", 1000.0 - age, key) for s, age, key in members]
    got = names.version_anomalies(spark.createDataFrame(data, "path string, stem string, ext string, mtime double, key string"))
    assert got.count() == expected


def test_catalog_order_of_tests(spark):
    data = [("/a/.DS_Store", ".DS_Store", 10, 1.0), ("/a/keep.bin", "keep.bin", 2048, 1.0), ("/a/x.tmp", "x.tmp", 2048, 1.0), ("/node_modules/y.bin", "y.bin", 2048, 1.0), ("/a/small.bin", "small.bin", 10, 1.0), ("/q/z.bin", "z.bin", 4096, 1.0), ("/qq/z.bin", "z.bin", 4096, 1.0)]
    df = spark.createDataFrame(data, "path string, name string, size long, mtime double")
    assert [r.path for r in catalog.catalog(df, 1024, "/q").orderBy("path").collect()] == ["/a/keep.bin", "/qq/z.bin"]
    assert [r.path for r in catalog.split_junk(df).where("junk").collect()] == ["/a/.DS_Store"]


def test_insights(spark):
    df = spark.createDataFrame([("/a/x", ".zip", 3, 1.0), ("/a/b/y", "", 5, 2e9), ("/c/z", ".zip", 2, 0.0)], "path string, ext string, size long, mtime double")
    assert rows(insights.totals(df)) == [(3, 10)]
    assert [r.path for r in insights.largest(df, 2).orderBy("rank").collect()] == ["/a/b/y", "/a/x"]
    assert [r.path for r in insights.stale(df, 2e9).collect()] == ["/a/x"]
    assert {r.ext: (r.bytes, r.n_files) for r in insights.by_extension(df).collect()} == {"(없음)": (5, 1), ".zip": (5, 2)}
    assert {r.folder: r.bytes for r in insights.folder_rollup(df).collect()} == {"": 10, "/a": 8, "/a/b": 5, "/c": 2}


def test_text(spark):
    df = spark.createDataFrame([("  A &amp;\t b\u00a0 c ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(textnorm.normalize(F.col("t"))).collect()] == ["A & b c", None, None]
    assert textnorm.decode_bytes("가".encode("utf-16")) == "가" and textnorm.decode_bytes(b"ok") == "ok"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one</w:t><w:t xml:space='preserve'>two</w:t></w:p>")
    assert textnorm.office_text(buffer.getvalue(), ".docx") == "one two"
    assert textnorm.office_text(b"broken", ".docx") is None


def test_near_documents(spark):
    base = [f"word{i}" for i in range(400)]
    data = [("a", " ".join(base)), ("b", " ".join([*base, "more", "words"])), ("c", " ".join(f"other{i}" for i in range(300))), ("d", "two words")]
    sigs = similar.signatures(spark.createDataFrame(data, "path string, normal string"))
    assert {r.path for r in sigs.collect()} == {"a", "b", "c"}
    assert rows(similar.near_clusters(sigs, 0.8)) == [("a", "a"), ("b", "a")]


def test_near_pairs_have_a_membership(spark, tmp_path):
    """Different texts of one signature: the pairs name the first, the membership names the rest."""
    words = [f"word{i}" for i in range(4000)]
    near = [f"other{i}" if i % 800 == 7 else w for i, w in enumerate(words)]
    texts = [words, *[[*words[:k], "changed", *words[k + 1 :]] for k in range(100, 4000, 300)], near]
    data = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sigs = {r.doc_id: r.sig for r in queries.QUERIES["minhash_signatures"](spark, str(tmp_path)).collect()}
    want = {(min(j for j in sigs if sigs[j] == sigs[i]), i) for i in sigs} - {(i, i) for i in sigs}
    assert want and {tuple(r) for r in queries.QUERIES["signature_copies"](spark, str(tmp_path)).collect()} == want
    pairs = {(r.a, r.b) for r in queries.QUERIES["near_pairs"](spark, str(tmp_path)).collect()}
    assert {i for pair in pairs | want for i in pair} == set(sigs)


def test_bits(spark):
    df = spark.createDataFrame([("x", "0" * 16), ("y", "0" * 15 + "3"), ("z", "f" * 16), ("bad", "zz")], "id string, hex string")
    prints = df.select("id", bits.hex_words(F.col("hex")).alias("words"))
    assert rows(bits.clusters(prints, 4)) == [("x", "x"), ("y", "x")]
    tags = bits.tagged_prints(spark.createDataFrame([("p", "cp:00"), ("q", "lc:00"), ("r", "ab")], "path string, print string"))
    assert {r.path: r.tag for r in tags.collect()} == {"p": "cp", "q": "lc", "r": "legacy"}


def test_sequences(spark):
    a = list(range(100))
    data = [(1, "cp", a), (2, "cp", [1, *a[1:]]), (3, "cp", [i * 7 + 13 for i in a]), (4, "lc", a), (5, "cp", a[:7]), (6, "cp", a[:7])]
    got = rows(sequences.ber_clusters(spark.createDataFrame(data, "id long, tag string, words array<bigint>"), 0.10))
    assert got == [(1, 1), (2, 1), (5, 5), (6, 5)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (5, 5), (None, 7)], "a long, b long")
    out = dict(connected_components(edges, spark.createDataFrame([(99,)], "id long").union(edges.select("b"))).collect())
    assert out[20] == 1 and out[31] == 30 and out[99] == 99
    assert connected_components(edges.limit(0)).count() == 0


def test_archives(spark):
    entries = spark.createDataFrame([("z1", "a", 1, 1), ("z1", "b", 2, 2), ("z2", "b", 2, 2), ("z2", "a", 1, 1), ("z3", "c", 3, 3), ("z3", "c", 3, 3)], "archive string, name string, size long, crc long")
    assert {r.archive for r in archives.manifest_groups(entries).collect()} == {"z1", "z2"}
    have = spark.createDataFrame([("C", 3), ("a", 1)], "name string, size long")
    assert rows(archives.unpacked_archives(entries, have)) == [("z3", 2)]


def test_empty_dirs(spark):
    tree = spark.createDataFrame([("/r",), ("/r/e1",), ("/r/e2",), ("/r/e2/sub",), ("/r/junk",), ("/r/real",)], "path string")
    files = spark.createDataFrame([("/r/junk/.DS_Store", True), ("/r/real/f.bin", False)], "path string, junk boolean")
    empty = dirs.empty_dirs(tree, files, ["/r"])
    assert rows(dirs.maximal(empty)) == [("/r/e1",), ("/r/e2",), ("/r/junk",)]


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1, 1.0, "p", "f"), ("b", 1, 1.0, "p", "f"), ("c", 1, 1.0, "p", "f")], "path string, size long, mtime double, partial_hash string, full_hash string")
    new = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("d", 1, 1.0)], "path string, size long, mtime double")
    assert dict(incremental.snapshot_delta(old, new).collect()) == {"a": "reused", "b": "changed", "c": "removed", "d": "new"}
    assert [(r.path, r.full_hash) for r in incremental.upsert(old, new).orderBy("path").collect()] == [("a", "f"), ("b", None), ("d", None)]
    assert rows(incremental.purged(old, new)) == [("c",)]


def test_plans(spark):
    items = spark.createDataFrame([("C:\\x\\a.txt",), ("c:\\X\\A.TXT",), ("/u/b.txt",)], "path string")
    plan = {r.src: r.dest for r in moves.move_plan(items, "/q", "1").collect()}
    assert len({d.lower() for d in plan.values()}) == 3 and plan["/u/b.txt"] == "/q/1/root/u/b.txt"
    with pytest.raises(ValueError):
        moves.purge_preview(items, "/q", 1.0, 0)
    with pytest.raises(ValueError):
        export.write_rows(items, "/nowhere", "xml")
    assert "</script><script>" not in export.html_report([{"p": "</script><script>"}], "t").replace("<script>const", "")


def test_media():
    import numpy as np

    ramp = np.tile(np.arange(9.0)[::-1], (8, 1))
    assert media.dhash_bits(ramp) == 2**64 - 1
    image = np.random.default_rng(1).random((64, 64))
    assert media.canonical(image, lambda v: media.phash_bits(media.resized(v, 32, 32))) == media.canonical(np.rot90(image), lambda v: media.phash_bits(media.resized(v, 32, 32)))


def test_stream(spark, tmp_path):
    from cairn.streaming.catalog_stream import follow

    spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "path string, size long, mtime double").write.parquet(str(tmp_path / "in/1"))
    spark.read.parquet(str(tmp_path / "in/1")).write.mode("append").parquet(str(tmp_path / "listings"))
    query = follow(spark, str(tmp_path / "listings"), str(tmp_path / "v"), str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "v/v=0")).count() == 2


def test_keeper_ties(spark):
    df = spark.createDataFrame([("/b/x", None), ("/a/x", 0.0), ("/download/x", 0.0)], "path string, mtime double")
    assert df.agg(keeper.keeper()).first()[0] == "/a/x"
