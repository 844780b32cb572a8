"""Registry of the engine's own queries and their SQL twins.

Every query runs over whole tables. The SQL shares one common table expression
for the virtual catalog, in which one document is one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import fixed
from .functions.paths import dirname, human_size, iso_time
from .operators import archives, audio, bits, catalog, dirs, errors, groups, hashing, incremental, insights, keeper, media, names, sequences, similar, textnorm
from .operators.components import connected_components
from .plans import export, moves
from .plans.doctor import doctor
from .session import materialize, ship, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

AS_OF = 1_700_000_000.0
CAT = """cat AS (
  SELECT doc_id, '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS name, '.txt' AS ext,
    CAST(strlen(text) AS BIGINT) AS size, CAST(1700000000 - (doc_id * 7919 % 1000) * 86400 AS DOUBLE) AS mtime, text AS content, sha256(text) AS full_hash
  FROM documents)"""
KEEP = """100 * CAST(regexp_matches(lower(path), 'download|다운로드|temp|임시|tmp|cache|캐시|\\$recycle|복사본|정리보관|_정리보관|new folder|새 폴더') AS INTEGER)
  + 50 * CAST(regexp_matches(stem, '(?i)복사본|사본|copy|\\(\\d+\\)|\\d+\\s*$|- ?copy') AS INTEGER)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The virtual catalog with full hashes."""
    return catalog.virtual_catalog(spark, sf_dir).withColumn("full_hash", hashing.full_hash(F.col("content")))


@query(f"WITH {CAT} SELECT path, name, ext, size, mtime FROM cat")
def catalog_scan(spark, sf_dir):
    return catalog.virtual_catalog(spark, sf_dir).select("path", "name", "ext", "size", "mtime")


@query(f"WITH {CAT} SELECT path FROM cat WHERE path NOT LIKE '/src3/%' AND name NOT LIKE '%7.txt'")
def glob_exclusion(spark, sf_dir):
    return catalog.exclude(catalog.virtual_catalog(spark, sf_dir), ("SRC3",), ("*7.TXT",)).select("path")


@query(f"WITH {CAT} SELECT path, name LIKE 'doc_1%' OR name LIKE '%99.txt' AS junk FROM cat")
def junk_split(spark, sf_dir):
    return catalog.split_junk(catalog.virtual_catalog(spark, sf_dir), ("doc?1*", "*99.txt")).select("path", "junk")


@query(f"WITH {CAT} SELECT path, size FROM cat WHERE size >= 1024")
def min_size_filter(spark, sf_dir):
    return catalog.at_least(catalog.virtual_catalog(spark, sf_dir), 1024).select("path", "size")


@query(f"WITH {CAT} SELECT path FROM cat WHERE path NOT LIKE '/src1/%'")
def quarantine_skip(spark, sf_dir):
    return catalog.outside_quarantine(catalog.virtual_catalog(spark, sf_dir), "/src1").select("path")


@query(f"WITH {CAT}, l AS (SELECT path, doc_id % 3 AS dev, doc_id // 6 AS ino FROM cat) SELECT path FROM (SELECT path, ino, row_number() OVER (PARTITION BY dev, ino ORDER BY path) AS n FROM l) WHERE n = 1 OR ino = 0")
def hardlink_dedupe(spark, sf_dir):
    links = catalog.virtual_catalog(spark, sf_dir).select("path", (F.col("doc_id") % 3).alias("dev"), F.floor(F.col("doc_id") / 6).alias("ino"))
    return catalog.one_per_inode(links).select("path")


@query(f"WITH {CAT} SELECT path, size FROM cat WHERE size IN (SELECT size FROM cat GROUP BY size HAVING count(*) > 1)")
def size_candidates(spark, sf_dir):
    return hashing.colliding(catalog.virtual_catalog(spark, sf_dir).select("path", "size"), "size").select("path", "size")


PARTIAL = "md5(CAST(CAST(size AS VARCHAR) AS BLOB) || CAST(array_slice(encode(content), 1, 65536) AS BLOB) || CASE WHEN size > 131072 THEN array_slice(encode(content), size - 65535, size) ELSE ''::BLOB END)"


@query(f"WITH {CAT}, p AS (SELECT path, size, {PARTIAL} AS partial_hash FROM cat) SELECT path, size, partial_hash FROM p WHERE (size, partial_hash) IN (SELECT (size, partial_hash) FROM p GROUP BY size, partial_hash HAVING count(*) > 1)")
def partial_candidates(spark, sf_dir):
    files = catalog.virtual_catalog(spark, sf_dir).select("path", "size", hashing.partial_hash(F.col("size"), F.col("content")).alias("partial_hash"))
    return hashing.colliding(files, "size", "partial_hash").select("path", "size", "partial_hash")


@query(
    f"""WITH {CAT}, s AS (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM cat), p AS (SELECT *, CASE WHEN n > 1 THEN {PARTIAL} END AS ph FROM s),
q AS (SELECT *, CASE WHEN ph IS NOT NULL THEN count(*) OVER (PARTITION BY size, ph) END AS m FROM p)
SELECT path, size, ph AS partial_hash, CASE WHEN m > 1 THEN full_hash END AS full_hash FROM q"""
)
def staged_full_hash(spark, sf_dir):
    return hashing.staged_hashes(catalog.virtual_catalog(spark, sf_dir)).select("path", "size", "partial_hash", "full_hash")


EXACT = f"""WITH {CAT}, stems AS (SELECT *, 'doc_' || doc_id AS stem FROM cat WHERE size > 0),
ranked AS (SELECT *, count(*) OVER (PARTITION BY full_hash) AS members,
  row_number() OVER (PARTITION BY full_hash ORDER BY {KEEP}, length(path) - length(replace(path, '/', '')), mtime, length(path), path) AS n FROM stems),
dup AS (SELECT full_hash AS group_id, path, size, mtime, members, size * (members - 1) AS reclaimable, CASE WHEN n = 1 THEN 'keep' ELSE 'move' END AS role FROM ranked WHERE members > 1)"""


@query(f"{EXACT} SELECT * FROM dup")
def exact_duplicates(spark, sf_dir):
    hashed = hashing.staged_hashes(catalog.virtual_catalog(spark, sf_dir))
    return groups.exact_duplicates(hashed)


@query(f"{EXACT} SELECT count(DISTINCT group_id) AS n_groups, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM dup WHERE role = 'move'")
def reclaimable_bytes(spark, sf_dir):
    return groups.reclaimable(exact_duplicates(spark, sf_dir))


SECOND = f"""{CAT}, alt AS (SELECT CASE doc_id % 4 WHEN 0 THEN '/home/download/' WHEN 1 THEN '/home/a/b/' WHEN 2 THEN '/tmp/' ELSE '/home/' END || CASE doc_id % 3 WHEN 0 THEN 'report copy ' WHEN 1 THEN 'report' ELSE 'note' END || CASE WHEN doc_id % 5 = 0 THEN ' (' || doc_id || ')' ELSE 'x' || doc_id || 'y' END || '.txt' AS path, source, mtime FROM cat JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
named AS (SELECT *, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') AS stem FROM alt),
scored AS (SELECT *, {KEEP} AS penalty, length(path) - length(replace(path, '/', '')) AS depth FROM named)"""


def _second_names(spark, sf_dir) -> DataFrame:
    files = catalog.virtual_catalog(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    i = F.col("doc_id")
    folder = F.when(i % 4 == 0, "/home/download/").when(i % 4 == 1, "/home/a/b/").when(i % 4 == 2, "/tmp/").otherwise("/home/")
    word = F.when(i % 3 == 0, "report copy ").when(i % 3 == 1, "report").otherwise("note")
    tail = F.when(i % 5 == 0, F.concat(F.lit(" ("), i.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("x"), i.cast("string"), F.lit("y")))
    return files.select(F.concat(folder, word, tail, F.lit(".txt")).alias("path"), "source", "mtime")


@query(f"WITH {SECOND} SELECT path, CAST(penalty AS INTEGER) AS penalty, CAST(depth AS INTEGER) AS depth FROM scored")
def keeper_penalty_scores(spark, sf_dir):
    files = _second_names(spark, sf_dir)
    return files.select("path", keeper.penalty(F.col("path")).cast("int").alias("penalty"), keeper.depth(F.col("path")).cast("int").alias("depth"))


@query(f"WITH {SECOND} SELECT source, path AS keep FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY penalty, depth, mtime, length(path), path) AS n FROM scored) WHERE n = 1")
def keeper_pick(spark, sf_dir):
    return _second_names(spark, sf_dir).groupBy("source").agg(keeper.keeper().alias("keep"))


@query(
    """WITH f AS (SELECT lower(p_name) AS lower_name, '/' || p_partkey AS path, p_brand || p_type AS key FROM part),
g AS (SELECT lower_name, count(*) AS members, count(DISTINCT key) AS contents FROM f GROUP BY lower_name HAVING count(*) > 1 AND count(DISTINCT key) > 1)
SELECT lower_name, path, members, contents, 'review' AS role FROM f JOIN g USING (lower_name)"""
)
def name_conflicts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return groups.name_conflicts(parts.select(F.concat(F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("name"), F.concat("p_brand", "p_type").alias("key")))


VERSIONED = """v AS (SELECT doc_id, 'plan ' || chr(CAST(97 + doc_id % 23 AS INTEGER)) || 'x' || CASE doc_id % 6 WHEN 0 THEN ' v1' WHEN 1 THEN ' v2' WHEN 2 THEN '_final' WHEN 3 THEN ' (3)' WHEN 4 THEN ' 2023-04-05' ELSE ' copy' END AS stem,
  '/' || doc_id AS path, '.txt' AS ext, CAST(1700000000 - (doc_id * 7919 % 1000) * 86400 AS DOUBLE) AS mtime, 'h:' || sha256(text) AS key FROM documents),
fam AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '20\\d{2}-\\d{2}-\\d{2}', ''), '(?i)(?:^|[ _\\-.(\\[])v\\.?\\s?(\\d{1,3})\\b', ''), '\\(\\d{1,3}\\)', ''), '(?i)copy', ''), '[ _\\-.]+(final$)?', ' ', 'g'))) || '|' || ext AS family,
  CASE doc_id % 6 WHEN 4 THEN 20230405 ELSE 0 END AS s_date, CASE doc_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 9 WHEN 2 THEN 13 ELSE -1 END AS s_keyword,
  CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 0 END AS s_number, CASE doc_id % 6 WHEN 5 THEN 1 ELSE 0 END AS s_copies FROM v)"""


def _versioned(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    tail = F.when(i % 6 == 0, " v1").when(i % 6 == 1, " v2").when(i % 6 == 2, "_final").when(i % 6 == 3, " (3)").when(i % 6 == 4, " 2023-04-05").otherwise(" copy")
    letter = F.chr((F.lit(97) + i % 23).cast("long"))
    return docs.select("doc_id", F.concat(F.lit("plan "), letter, F.lit("x"), tail).alias("stem"), F.concat(F.lit("/"), i.cast("string")).alias("path"), F.lit(".txt").alias("ext"), (F.lit(1700000000) - (i * 7919 % 1000) * 86400).cast("double").alias("mtime"), F.concat(F.lit("h:"), hashing.full_hash(F.col("text"))).alias("key"))


@query(f"WITH {VERSIONED} SELECT path, family FROM fam")
def version_family(spark, sf_dir):
    return _versioned(spark, sf_dir).select("path", names.family(F.col("stem"), F.col("ext")).alias("family"))


@query(f"WITH {VERSIONED} SELECT path, CAST(s_date AS INTEGER) AS date, CAST(s_keyword AS INTEGER) AS keyword, CAST(s_number AS INTEGER) AS number, CAST(s_copies AS INTEGER) AS copies FROM fam")
def version_score(spark, sf_dir):
    return _versioned(spark, sf_dir).select("path", names.score(F.col("stem")).alias("s")).select("path", "s.*")


@query(
    f"""WITH {VERSIONED}, g AS (SELECT family, count(*) AS n, count(DISTINCT key) AS c, count(DISTINCT (s_date, s_keyword, s_number, s_copies)) AS s, max((s_date, s_keyword, s_number, s_copies)) AS top, max(mtime) AS newest FROM fam GROUP BY family),
j AS (SELECT fam.*, top, newest FROM fam JOIN g USING (family) WHERE n > 1 AND c > 1 AND s > 1),
p AS (SELECT family, min(CASE WHEN (s_date, s_keyword, s_number, s_copies) = top THEN path END) AS claimed_latest, min(CASE WHEN mtime = newest THEN path END) AS mtime_latest FROM j GROUP BY family)
SELECT family, path, claimed_latest, mtime_latest, CASE WHEN path = claimed_latest THEN 'claimed_latest' WHEN path = mtime_latest THEN 'mtime_latest' ELSE '' END AS tag FROM j JOIN p USING (family) WHERE claimed_latest <> mtime_latest"""
)
def version_anomalies(spark, sf_dir):
    out = names.version_anomalies(_versioned(spark, sf_dir))
    return out.select("family", "path", "claimed_latest", "mtime_latest", F.array_join("tags", ",").alias("tag"))


@query(f"WITH {CAT} SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM cat")
def totals(spark, sf_dir):
    return insights.totals(catalog.virtual_catalog(spark, sf_dir))


@query(f"WITH {CAT}, r AS (SELECT path, size, CAST(row_number() OVER (ORDER BY size DESC, path) AS INTEGER) AS rank FROM cat) SELECT * FROM r WHERE rank <= 60")
def largest_files(spark, sf_dir):
    return insights.largest(catalog.virtual_catalog(spark, sf_dir))


@query(f"WITH {CAT}, r AS (SELECT path, size, mtime, CAST(row_number() OVER (ORDER BY size DESC, path) AS INTEGER) AS rank FROM cat WHERE mtime <> 0 AND mtime < {AS_OF} - 63072000.0) SELECT * FROM r WHERE rank <= 60")
def stale_files(spark, sf_dir):
    return insights.stale(catalog.virtual_catalog(spark, sf_dir), AS_OF)


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN '(없음)' ELSE '.' || lang END AS ext, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS n_files FROM documents GROUP BY 1")
def by_extension(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return insights.by_extension(docs.select(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("."), "lang")).alias("ext"), F.octet_length("text").alias("size")))


@query(
    """WITH f AS (SELECT string_split(url, '/') AS parts, strlen(html) AS size FROM pages),
a AS (SELECT array_to_string(parts[1:i], '/') AS folder, size FROM (SELECT parts, size, unnest(range(1, len(parts))) AS i FROM f)),
g AS (SELECT folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n_files FROM a GROUP BY folder)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY bytes DESC, folder) AS INTEGER) AS rank FROM g) WHERE rank <= 40"""
)
def folder_rollup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return insights.folder_rollup(pages.select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size")))


@query(
    """SELECT r_name AS region, n_name AS nation, count(*) AS n_customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""
)
def hierarchy_rollup(spark, sf_dir):
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n_customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query(r"SELECT doc_id, nullif(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')), '') AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textnorm.collapse(F.col("text")).alias("normal"))


@query(
    r"""WITH t AS (SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g'))) AS h FROM documents WHERE trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) <> '')
SELECT h AS text_hash, doc_id, members FROM (SELECT *, count(*) OVER (PARTITION BY h) AS members FROM t) WHERE members > 1"""
)
def doc_same_text(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", textnorm.text_hash(textnorm.collapse(F.col("text"))).alias("text_hash")).where("text_hash is not null")
    sizes = hashed.groupBy("text_hash").agg(F.count("*").alias("members")).where("members > 1")
    return hashed.join(sizes, "text_hash").select("text_hash", "doc_id", "members")


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x0b]+', ' ', 'g')), '') AS text FROM pages")
def markup_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", textnorm.collapse(textnorm.strip_markup(F.col("html"))).alias("text"))


@query(r"SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '[\s\x0b]+', ' ', 'g')) AS text FROM conversations GROUP BY conv_id")
def multipart_text(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return parts.select("conv_id", textnorm.collapse(F.array_join(F.col("parts")["text"], " ")).alias("text"))


@query()
def entity_unescape(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", textnorm.normalize(textnorm.strip_markup(F.col("html"))).alias("text"))


NORMAL = r"""n AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) <> ''),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w[i] ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) < 5 THEN len(w) + 1 ELSE len(w) - 3 END)) AS i FROM n))"""


def _normal_files(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.where(textnorm.seen(F.col("text"))).select(F.col("doc_id").alias("path"), textnorm.spaced(F.col("text")).alias("normal"))


@query(f"WITH {NORMAL} SELECT doc_id, count(*) AS n_shingles FROM sh GROUP BY doc_id")
def shingle_counts(spark, sf_dir):
    return _normal_files(spark, sf_dir).select(F.col("path").alias("doc_id"), F.size(similar.shingles(F.col("normal"))).cast("long").alias("n_shingles"))


@query(
    f"""WITH {NORMAL}, c AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY doc_id), first AS (SELECT k, min(doc_id) AS head FROM c GROUP BY k),
hs AS (SELECT sh.* FROM sh JOIN first ON doc_id = head), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM hs x JOIN hs y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, common, cx.n + cy.n - common AS joint FROM p JOIN c cx ON a = cx.doc_id JOIN c cy ON b = cy.doc_id WHERE common >= 0.5 * (cx.n + cy.n - common)
UNION ALL SELECT head, doc_id, n, n FROM c JOIN first USING (k) WHERE doc_id <> head"""
)
def exact_jaccard_pairs(spark, sf_dir):
    return similar.exact_pairs(_normal_files(spark, sf_dir), fixed.TEXT_NEAR_THRESHOLD)


COEFFICIENTS = f"coef AS (SELECT unnest({similar.A}) AS a, unnest({similar.B}) AS b, unnest(range(64)) AS i)"
SIGS = f"""WITH {NORMAL}, h AS (SELECT doc_id, CAST('0x' || md5(s)[1:8] AS BIGINT) % 2147483647 AS h FROM sh WHERE doc_id IN (SELECT doc_id FROM sh GROUP BY doc_id HAVING count(*) >= 4)),
{COEFFICIENTS}, m AS (SELECT doc_id, i, min((a * h + b) % 2147483647) AS v FROM h, coef GROUP BY doc_id, i),
sig AS (SELECT doc_id, list(v ORDER BY i) AS sig FROM m GROUP BY doc_id)"""


@query(f"{SIGS} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sig")
def minhash_signatures(spark, sf_dir):
    return similar.signatures(_normal_files(spark, sf_dir)).select(F.col("path").alias("doc_id"), F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


BANDED = f"""{SIGS}, bands AS (SELECT doc_id, sig, k, sig[4 * k + 1:4 * k + 4] AS band FROM sig, range(16) AS r(k)),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.sig AS sa, y.sig AS sb FROM bands x JOIN bands y ON x.k = y.k AND x.band = y.band AND x.doc_id < y.doc_id),
near AS MATERIALIZED (SELECT a, b, CAST(len(list_filter(range(1, 65), lambda i: sa[i] = sb[i])) AS INTEGER) AS equal FROM cand)"""


@query(f"{BANDED}, first AS (SELECT min(doc_id) AS id FROM sig GROUP BY sig) SELECT a, b FROM near WHERE equal < 64 AND a IN (SELECT id FROM first) AND b IN (SELECT id FROM first)")
def lsh_candidates(spark, sf_dir):
    """Candidates between distinct signatures, each by its first document."""
    sigs = materialize(similar.signatures(_normal_files(spark, sf_dir)), "sigs")
    heads = sigs.groupBy("sig").agg(F.min("path").alias("path"))
    return similar.band_candidates(heads)


@query(f"{BANDED}, first AS (SELECT min(doc_id) AS id FROM sig GROUP BY sig) SELECT a, b, equal FROM near WHERE equal BETWEEN 32 AND 63 AND a IN (SELECT id FROM first) AND b IN (SELECT id FROM first)")
def near_pairs(spark, sf_dir):
    sigs = materialize(similar.signatures(_normal_files(spark, sf_dir)), "sigs")
    heads = sigs.groupBy("sig").agg(F.min("path").alias("path"))
    return similar.near_pairs(heads, fixed.TEXT_NEAR_THRESHOLD).select("a", "b", F.round(F.col("similarity") * 64).cast("int").alias("equal"))


@query(f"{SIGS}, first AS (SELECT sig, min(doc_id) AS a FROM sig GROUP BY sig) SELECT a, doc_id AS b FROM sig JOIN first USING (sig) WHERE a <> doc_id")
def signature_copies(spark, sf_dir):
    """The membership of the documents that stand for a signature in lsh_candidates and near_pairs."""
    return similar.signature_copies(materialize(similar.signatures(_normal_files(spark, sf_dir)), "sigs"))


REACH = "reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT sym.a, reach.r FROM sym JOIN reach ON sym.b = reach.id)"


@query(
    f"""WITH RECURSIVE {BANDED[5:]}, sym AS MATERIALIZED (SELECT a, b FROM near WHERE equal >= 32 UNION ALL SELECT b, a FROM near WHERE equal >= 32), {REACH},
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id), t AS (SELECT component, id, array_to_string(w, ' ') AS norm, text FROM comp JOIN n ON n.doc_id = id JOIN documents d ON d.doc_id = id),
ok AS (SELECT component, count(*) AS members FROM t GROUP BY component HAVING count(*) > 1 AND count(DISTINCT norm) > 1 AND count(DISTINCT text) > 1),
{CAT}, r AS (SELECT component AS group_id, id AS doc_id, members, path, mtime, 'doc_' || id AS stem FROM t JOIN ok USING (component) JOIN cat ON cat.doc_id = id)
SELECT group_id, doc_id, members, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY {KEEP}, length(path) - length(replace(path, '/', '')), mtime, length(path), path) = 1 THEN 'keep' ELSE 'move' END AS role FROM r"""
)
def near_groups(spark, sf_dir):
    files = _normal_files(spark, sf_dir)
    labels = similar.near_clusters(materialize(similar.signatures(files), "sigs"), fixed.TEXT_NEAR_THRESHOLD)
    files = materialize(_texts(spark, sf_dir), "texts")
    labels = labels.withColumnRenamed("path", "doc_id").join(files.select("doc_id", "path"), "doc_id").select("path", "component")
    return groups.labelled_groups(files, labels, "txt").join(files.select("path", "doc_id"), "path").select("group_id", "doc_id", "members", "role")


def _texts(spark, sf_dir) -> DataFrame:
    """doc_id, path, size, mtime, key, txt of the virtual catalog."""
    files = files_of(spark, sf_dir)
    return files.select("doc_id", "path", "size", "mtime", groups.content_key(F.col("full_hash"), F.col("path")).alias("key"), textnorm.text_hash(textnorm.collapse(F.col("content"))).alias("txt"))


SAME_TEXT = rf"""WITH {CAT}, spaced AS (SELECT doc_id, path, size, mtime, content FROM cat UNION ALL SELECT doc_id, '/copies' || path, size + 1, mtime, content || ' ' FROM cat WHERE doc_id % 10 = 0),
x AS (SELECT *, sha256(content) AS full_hash, sha256(trim(regexp_replace(content, '[\s\x0b]+', ' ', 'g'))) AS txt, 'doc_' || doc_id AS stem FROM spaced WHERE trim(regexp_replace(content, '[\s\x0b]+', ' ', 'g')) <> ''),
g AS (SELECT txt, count(*) AS members FROM x GROUP BY txt HAVING count(*) > 1 AND count(DISTINCT full_hash) > 1),
st AS (SELECT txt AS group_id, path, size, mtime, members, CASE WHEN row_number() OVER (PARTITION BY txt ORDER BY {KEEP}, length(path) - length(replace(path, '/', '')), mtime, length(path), path) = 1 THEN 'keep' ELSE 'move' END AS role FROM x JOIN g USING (txt))"""


@query(f"{SAME_TEXT} SELECT group_id, path, members, role FROM st")
def doc_groups(spark, sf_dir):
    """Documents with one text but not one content; each tenth has a copy with a blank more."""
    return groups.same_fingerprint(materialize(_spaced(spark, sf_dir), "texts"), "txt")


def _spaced(spark, sf_dir) -> DataFrame:
    files = catalog.virtual_catalog(spark, sf_dir).select("doc_id", "path", "size", "mtime", "content")
    copies = files.where("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("/copies"), "path").alias("path"), (F.col("size") + 1).alias("size"), "mtime", F.concat("content", F.lit(" ")).alias("content"))
    both = files.unionByName(copies)
    return both.select("path", "size", "mtime", groups.content_key(hashing.full_hash(F.col("content")), F.col("path")).alias("key"), textnorm.text_hash(textnorm.collapse(F.col("content"))).alias("txt"))


BITS = """w AS (SELECT vec_id, embedding AS e, list_sort(embedding) AS s FROM embeddings),
plain AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN CAST(x AS DOUBLE) > (s[32] + s[33]) / 2 THEN 1 ELSE 0 END) AS b FROM w),
bits AS (SELECT vec_id, b FROM plain UNION ALL SELECT 1000000000 + vec_id, list_transform(b, lambda x, i: CASE WHEN i <= vec_id // 4 % 17 THEN 1 - x ELSE x END) FROM plain WHERE vec_id % 4 = 0),
d AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x.b[i] <> y.b[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM bits x JOIN bits y ON x.vec_id < y.vec_id)"""


def _flipped(word, n):
    """A word with its n first bits, from the top, inverted; n below 64."""
    return word.bitwiseXOR(F.when(n > 0, F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - n).cast("int"))).otherwise(F.lit(0).cast("long")))


def _vector_prints(spark, sf_dir) -> DataFrame:
    """A print for each vector, and for each fourth a neighbour 0 to 16 bits away."""
    plain = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), media.median_words(F.col("embedding")).alias("words"))
    near = plain.where("id % 4 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.array(_flipped(F.get("words", F.lit(0)), F.floor(F.col("id") / 4) % 17)).alias("words"))
    return plain.unionByName(near)


@query(f"WITH {BITS} SELECT a, b, distance FROM d WHERE distance <= 14")
def hamming_pairs(spark, sf_dir):
    return bits.all_hamming_pairs(_vector_prints(spark, sf_dir), 14)


@query(f"WITH RECURSIVE {BITS}, sym AS MATERIALIZED (SELECT a, b FROM d WHERE distance <= 14 UNION ALL SELECT b, a FROM d WHERE distance <= 14), {REACH} SELECT id, min(r) AS component FROM reach GROUP BY id")
def bit_clusters(spark, sf_dir):
    return bits.clusters(_vector_prints(spark, sf_dir), 14)


@query(f"WITH {BITS}, g AS (SELECT b, count(*) AS members FROM bits GROUP BY b HAVING count(*) > 1) SELECT vec_id AS id, members FROM bits JOIN g USING (b)")
def image_strict_groups(spark, sf_dir):
    prints = _vector_prints(spark, sf_dir)
    return prints.join(prints.groupBy("words").agg(F.count("*").alias("members")).where("members > 1"), "words").select("id", "members")


@query(f"WITH RECURSIVE {BITS}, sym AS MATERIALIZED (SELECT a, b FROM d WHERE distance <= 6 UNION ALL SELECT b, a FROM d WHERE distance <= 6), {REACH}, c AS (SELECT id, min(r) AS component FROM reach GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS members FROM c")
def image_loose_groups(spark, sf_dir):
    labels = bits.clusters(_vector_prints(spark, sf_dir), fixed.IMAGE_THRESHOLD)
    return labels.join(labels.groupBy("component").agg(F.count("*").alias("members")), "component").select("id", "component", "members")


@query(
    """WITH w AS (SELECT vec_id, label, embedding AS e, list_sort(embedding) AS s FROM embeddings), g AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, list_transform(e, lambda x: CASE WHEN CAST(x AS DOUBLE) > (s[32] + s[33]) / 2 THEN 1 ELSE 0 END) AS b FROM w),
v AS (SELECT label, n // 5 AS k, flatten(list(b ORDER BY n)) AS b FROM g GROUP BY 1, 2 HAVING count(*) = 5), o AS (SELECT label * 1000000 + k AS id, b FROM v), i AS (SELECT id, b FROM o UNION ALL SELECT 500000000000 + id, list_transform(b, lambda x, j: CASE WHEN j <= id % 61 THEN 1 - x ELSE x END) FROM o)
SELECT x.id AS a, y.id AS b, CAST(list_sum(list_transform(range(1, 321), lambda j: CASE WHEN x.b[j] <> y.b[j] THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM i x JOIN i y ON x.id < y.id WHERE list_sum(list_transform(range(1, 321), lambda j: CASE WHEN x.b[j] <> y.b[j] THEN 1 ELSE 0 END)) <= 40"""
)
def video_pairs(spark, sf_dir):
    """Five 64-bit frames make one video print; each has a neighbour 0 to 60 bits away."""
    return bits.all_hamming_pairs(_video_prints(spark, sf_dir), fixed.VIDEO_THRESHOLD)


def _video_prints(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).withColumn("k", F.floor(F.col("n") / 5))
    rows = rows.groupBy("label", "k").agg(F.sort_array(F.collect_list(F.struct("n", media.median_words(F.col("embedding")).alias("w")))).alias("f")).where(F.size("f") == 5)
    own = rows.select((F.col("label") * F.lit(1000000).cast("long") + F.col("k")).alias("id"), F.flatten(F.col("f")["w"]).alias("words"))
    near = own.select((F.col("id") + 500_000_000_000).alias("id"), F.concat(F.array(_flipped(F.get("words", F.lit(0)), F.col("id") % 61)), F.slice("words", 2, 4)).alias("words"))
    return own.unionByName(near)


SEQ = """own AS (SELECT user_id, list((CAST(floor(value * 100) AS BIGINT) * 2654435761) & 4294967295 ORDER BY event_id) AS w FROM events GROUP BY user_id),
seq AS (SELECT user_id * 4 + k AS id, CASE user_id % 2 WHEN 0 THEN 'cp' ELSE 'lc' END AS tag, CASE k WHEN 0 THEN w WHEN 1 THEN list_transform(w, lambda x, i: xor(x, CAST(1 AS BIGINT) << (i % 32)))
  WHEN 2 THEN list_transform(w, lambda x, i: xor(x, CAST(7 AS BIGINT) << (i % 29))) ELSE w[2:] END AS w FROM own, range(4) AS r(k) WHERE k = 0 OR user_id % 5 = 0),
r AS (SELECT x.id AS a, y.id AS b, len(x.w) AS nx, len(y.w) AS ny, x.w AS wx, y.w AS wy FROM seq x JOIN seq y ON x.tag = y.tag AND x.id < y.id),
shifts AS (SELECT a, b, sh, least(nx, ny) - abs(sh) AS m, wx, wy FROM r, (VALUES (0), (1), (2), (-1), (-2)) AS s(sh)),
rates AS (SELECT a, b, CASE WHEN m >= 8 THEN list_sum(list_transform(range(1, m + 1), lambda i: bit_count(xor(wx[i + greatest(sh, 0)], wy[i + greatest(-sh, 0)])))) / (m * 32) ELSE 1.0 END AS ber FROM shifts),
best AS MATERIALIZED (SELECT a, b, min(ber) AS ber FROM rates GROUP BY a, b)"""


def _event_prints(spark, sf_dir) -> DataFrame:
    """The events of a user as 32-bit words; each fifth user has neighbours with 1 and 3 bits of each word inverted, and one that begins a word later."""
    word = (F.floor(F.col("value") * 100).cast("long") * 2654435761).bitwiseAND(F.lit(4294967295))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("user")).agg(F.sort_array(F.collect_list(F.struct("event_id", word.alias("w")))).alias("s"))
    rows = rows.select("user", F.col("s")["w"].alias("w"), F.explode(F.when(F.col("user") % 5 == 0, F.array(*[F.lit(k) for k in range(4)])).otherwise(F.array(F.lit(0)))).alias("k"))
    flip = lambda bits, wide: F.transform("w", lambda x, i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(bits).cast("long"), (i + 1) % wide)))
    words = F.when(F.col("k") == 0, F.col("w")).when(F.col("k") == 1, flip(1, 32)).when(F.col("k") == 2, flip(7, 29)).otherwise(F.slice("w", F.lit(2), F.size("w")))
    return rows.select((F.col("user") * 4 + F.col("k")).alias("id"), F.when(F.col("user") % 2 == 0, "cp").otherwise("lc").alias("tag"), words.alias("words"))


@query(f"WITH {SEQ} SELECT a, b, CAST(round(ber * 1000000) AS BIGINT) AS ber_millionths FROM best WHERE ber <= 0.1")
def ber_pairs(spark, sf_dir):
    return sequences.all_ber_pairs(_event_prints(spark, sf_dir), fixed.AUDIO_BER).select("a", "b", F.round(F.col("ber") * 1000000).cast("long").alias("ber_millionths"))


@query(f"WITH RECURSIVE {SEQ}, sym AS MATERIALIZED (SELECT a, b FROM best WHERE ber <= 0.1 UNION ALL SELECT b, a FROM best WHERE ber <= 0.1), {REACH} SELECT id, min(r) AS component FROM reach GROUP BY id")
def ber_clusters(spark, sf_dir):
    prints = _event_prints(spark, sf_dir)
    return sequences.ber_clusters(prints.where(F.size("words") >= sequences.LEAST_WORDS), fixed.AUDIO_BER)


@query(f"WITH {SEQ} SELECT tag, count(*) AS prints, count(DISTINCT w) AS contents FROM seq GROUP BY tag")
def tag_separation(spark, sf_dir):
    return _event_prints(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("prints"), F.count_distinct("words").alias("contents"))


LOCAL = """vw AS (SELECT vec_id, label, embedding AS e, list_sort(embedding) AS s FROM embeddings), vg AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, list_transform(e, lambda x: CASE WHEN CAST(x AS DOUBLE) > (s[32] + s[33]) / 2 THEN 1 ELSE 0 END) AS b FROM vw),
vv AS (SELECT label * 1000000 + n // 5 AS id, (flatten(list(b ORDER BY n)))[1:256] AS b FROM vg GROUP BY label, n // 5 HAVING count(*) = 5), vi AS (SELECT id, b FROM vv UNION ALL SELECT 500000000000 + id, list_transform(b, lambda x, j: CASE WHEN j <= id % 61 THEN 1 - x ELSE x END) FROM vv),
lc AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM vi x JOIN vi y ON x.id < y.id WHERE list_sum(list_transform(range(1, 257), lambda j: CASE WHEN x.b[j] <> y.b[j] THEN 1 ELSE 0 END)) <= 40)"""


@query(
    f"""WITH RECURSIVE {SEQ}, {BITS}, {LOCAL}, e AS (SELECT 'cp:' || a AS a, 'cp:' || b AS b FROM best JOIN seq ON seq.id = a WHERE ber <= 0.1 AND tag = 'cp'
UNION ALL SELECT 'lc:' || a, 'lc:' || b FROM lc UNION ALL SELECT 'legacy:' || a, 'legacy:' || b FROM d WHERE distance <= 10), sym AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), {REACH},
c AS (SELECT split_part(id, ':', 1) AS tag, CAST(split_part(id, ':', 2) AS BIGINT) AS id, CAST(split_part(r, ':', 2) AS BIGINT) AS r FROM reach) SELECT id, tag, min(r) AS component FROM c GROUP BY id, tag"""
)
def audio_clusters(spark, sf_dir):
    """Sequences, local prints and untagged ones of equal ids, as hex."""
    hexed = lambda words, wide: F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), wide, "0")), "")
    swapped = F.transform("words", lambda w: F.shiftleft(w.bitwiseAND(255), 24).bitwiseOR(F.shiftleft(w.bitwiseAND(0xFF00), 8)).bitwiseOR(F.shiftright(w, 8).bitwiseAND(0xFF00)).bitwiseOR(F.shiftright(w, 24)))
    runs = _event_prints(spark, sf_dir).where("tag = 'cp'").where(F.size("words") >= sequences.LEAST_WORDS).select("id", F.concat(F.lit("cp:"), hexed(swapped, 8)).alias("print"))
    local = _video_prints(spark, sf_dir).select("id", F.concat(F.lit("lc:"), hexed(F.slice("words", 1, 4), 16)).alias("print"))
    plain = _vector_prints(spark, sf_dir).select("id", hexed(F.col("words"), 16).alias("print"))
    return audio.audio_clusters(runs.unionByName(local).unionByName(plain))


ENTRIES = "ent AS (SELECT l_orderkey AS archive, 'Part' || (l_partkey % 50) AS name, CAST(l_quantity AS BIGINT) % 3 AS size, CAST(l_suppkey % 2 AS BIGINT) AS crc FROM lineitem)"


def _order_entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.concat(F.lit("Part"), (F.col("l_partkey") % 50).cast("string")).alias("name"), (F.col("l_quantity").cast("long") % 3).alias("size"), (F.col("l_suppkey") % 2).cast("long").alias("crc"))


@query(
    f"""WITH {ENTRIES}, m AS (SELECT archive, sha256(string_agg(name || '|' || size || '|' || crc, chr(10) ORDER BY name || '|' || size || '|' || crc)) AS manifest, count(*) AS entries FROM ent GROUP BY archive)
SELECT manifest, archive, entries, members FROM (SELECT *, count(*) OVER (PARTITION BY manifest) AS members FROM m) WHERE members > 1"""
)
def archive_manifest_groups(spark, sf_dir):
    return archives.manifest_groups(_order_entries(spark, sf_dir))


@query(
    f"""WITH {ENTRIES}, have AS (SELECT DISTINCT lower('part' || (p_partkey % 40)) AS name, CAST(p_size % 3 AS BIGINT) AS size FROM part)
SELECT archive, count(*) AS entries FROM ent LEFT JOIN have ON lower(ent.name) = have.name AND ent.size = have.size GROUP BY archive HAVING count(*) = count(have.name)"""
)
def unpacked_archives(spark, sf_dir):
    have = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), (F.col("p_partkey") % 40).cast("string")).alias("name"), (F.col("p_size") % 3).cast("long").alias("size"))
    return archives.unpacked_archives(_order_entries(spark, sf_dir), have)


SNAP = f"""{CAT}, old AS (SELECT path, size, mtime, md5(path) AS partial_hash, full_hash FROM cat WHERE doc_id % 5 <> 0), new AS (SELECT path, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, mtime + CASE WHEN doc_id % 11 = 0 THEN 5 ELSE 0 END AS mtime FROM cat WHERE doc_id % 6 <> 0)"""


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = files_of(spark, sf_dir)
    i = F.col("doc_id")
    old = files.where(i % 5 != 0).select("path", "size", "mtime", F.md5(F.col("path").cast("binary")).alias("partial_hash"), "full_hash")
    new = files.where(i % 6 != 0).select("path", (F.col("size") + F.when(i % 7 == 0, 1).otherwise(0)).alias("size"), (F.col("mtime") + F.when(i % 11 == 0, 5).otherwise(0)).alias("mtime"))
    return old, new


@query(f"WITH {SNAP} SELECT path, CASE WHEN new.path IS NULL THEN 'removed' WHEN old.path IS NULL THEN 'new' WHEN old.size = new.size AND abs(old.mtime - new.mtime) < 1e-6 THEN 'reused' ELSE 'changed' END AS status FROM old FULL JOIN new USING (path)")
def snapshot_delta(spark, sf_dir):
    return incremental.snapshot_delta(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAP}, j AS (SELECT new.*, old.size = new.size AND abs(old.mtime - new.mtime) < 1e-6 AS same, partial_hash, full_hash FROM new LEFT JOIN old USING (path)) SELECT path, size, mtime, CASE WHEN same THEN partial_hash END AS partial_hash, CASE WHEN same THEN full_hash END AS full_hash FROM j")
def upsert_merge(spark, sf_dir):
    return incremental.upsert(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def purge_missing(spark, sf_dir):
    return incremental.purged(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT path, size, mtime, full_hash FROM new LEFT JOIN old USING (path, size, mtime)")
def fingerprint_cache_reuse(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    hits, misses = incremental.reuse_fingerprints(new, old.select("path", "size", "mtime", "full_hash").withColumn("settings", F.lit("d1")), "d1")
    return hits.select("path", "size", "mtime", "full_hash").unionByName(misses.select("path", "size", "mtime").withColumn("full_hash", F.lit(None).cast("string")))


@query("SELECT at_us, id, CAST(rank AS INTEGER) AS rank FROM (SELECT epoch_us(ts) AS at_us, event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50")
def scan_history_tail(spark, sf_dir):
    return incremental.history_tail(table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))).withColumnRenamed("at", "at_us")


TREE = f"""{CAT}, dirs AS (SELECT DISTINCT '/' || source AS path FROM documents UNION SELECT DISTINCT '/' || source || '/' || lang FROM documents), fs AS (SELECT path, regexp_matches(name, '[0-8]\\.txt$') OR path LIKE '/src1%' AS junk FROM cat),
filled AS (SELECT DISTINCT '/' || string_split(path, '/')[2] AS path FROM fs WHERE NOT junk UNION SELECT DISTINCT '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] FROM fs WHERE NOT junk), empty AS (SELECT path FROM dirs WHERE path NOT IN (SELECT path FROM filled))"""


def _tree(spark, sf_dir) -> DataFrame:
    files = catalog.virtual_catalog(spark, sf_dir).select("path", (F.col("name").rlike(r"[0-8]\.txt$") | F.col("path").startswith("/src1")).alias("junk"))
    inner = files.select(dirname(F.col("path")).alias("path")).distinct()
    return dirs.empty_dirs(inner.union(inner.select(dirname(F.col("path")))).distinct(), files, [""])


@query(f"WITH {TREE} SELECT path FROM empty")
def empty_dirs(spark, sf_dir):
    return _tree(spark, sf_dir)


@query(f"WITH {TREE} SELECT path FROM empty WHERE regexp_replace(path, '/[^/]*$', '') NOT IN (SELECT path FROM empty)")
def maximal_empty_dirs(spark, sf_dir):
    return dirs.maximal(_tree(spark, sf_dir))


HUMAN = "CASE WHEN size < 1024 THEN size || 'B' WHEN size < 1048576 THEN printf('%.1fKB', size / 1024.0) ELSE printf('%.1fMB', size / 1048576.0) END"
FLAT = f"""{EXACT}, flat AS (SELECT 'dup' AS category, 'Exact duplicates' AS category_title, CAST(dense_rank() OVER (ORDER BY group_id) AS INTEGER) AS "group", CASE role WHEN 'keep' THEN 'keeper' ELSE 'move' END AS role, path,
  regexp_replace(path, '^.*/', '') AS name, regexp_replace(path, '/[^/]*$', '') AS folder, size AS size_bytes, {HUMAN} AS size_human, strftime(make_timestamp(CAST(mtime AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS mtime_iso FROM dup)"""


def _flat(spark, sf_dir) -> DataFrame:
    return export.flat_rows(exact_duplicates(spark, sf_dir), "dup", "Exact duplicates")


@query(f"{FLAT} SELECT * FROM flat")
def flat_rows(spark, sf_dir):
    return _flat(spark, sf_dir)


@query(f"{FLAT} SELECT category, count(DISTINCT \"group\") AS n_groups, count(*) AS n_rows FROM flat GROUP BY category")
def category_counts(spark, sf_dir):
    return export.category_counts(_flat(spark, sf_dir))


@query(f"{FLAT} SELECT *, category = 'dup' AND role = 'move' AS prechecked FROM flat")
def prechecked_rows(spark, sf_dir):
    return export.prechecked(_flat(spark, sf_dir))


@query(f"{FLAT} SELECT count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM flat WHERE role = 'move'")
def selection_total(spark, sf_dir):
    return export.selection_total(export.prechecked(_flat(spark, sf_dir)))


@query(f"{FLAT}, w AS (SELECT *, count(*) OVER (PARTITION BY category, \"group\") AS group_rows FROM flat) SELECT * FROM w WHERE contains(lower(path), '/en/') AND size_bytes >= 1024")
def result_filter(spark, sf_dir):
    return export.result_filter(_flat(spark, sf_dir), "/EN/", 1024)


@query(f"""{FLAT} SELECT category, "group", CAST(to_json({{'group': "group", 'files': list({{'path': path, 'name': name, 'size_bytes': size_bytes, 'role': role}} ORDER BY path)}}) AS VARCHAR) AS json FROM flat GROUP BY category, "group\"""")
def json_export(spark, sf_dir):
    return export.nested_json(_flat(spark, sf_dir))


@query(f"{EXACT}, m AS (SELECT path, '/keep/20240101/root/' || ltrim(path, '/') AS dest FROM dup WHERE role = 'move') SELECT path AS src, dest FROM m")
def move_plan(spark, sf_dir):
    return moves.move_plan(exact_duplicates(spark, sf_dir).where("role = 'move'").select("path"), "/keep", "20240101")


@query(f"WITH {CAT}, m AS (SELECT path AS src, '/q' || path AS dest, doc_id FROM cat) SELECT src, dest, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'occupied' ELSE 'restore' END AS action FROM m")
def undo_plan(spark, sf_dir):
    files = catalog.virtual_catalog(spark, sf_dir)
    manifest = files.select(F.col("path").alias("src"), F.concat(F.lit("/q"), "path").alias("dest"))
    existing = files.where("doc_id % 3 <> 0").select(F.concat(F.lit("/q"), "path").alias("path")).union(files.where("doc_id % 4 = 0").select("path"))
    return moves.undo_plan(manifest, existing)


@query(f"WITH {CAT} SELECT string_split(path, '/')[2] AS folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n_files FROM cat GROUP BY 1 HAVING max(mtime) < {AS_OF} - 10 * 86400.0")
def purge_preview(spark, sf_dir):
    files = catalog.virtual_catalog(spark, sf_dir).select(F.concat(F.lit("/q"), "path").alias("path"), "size", "mtime")
    return moves.purge_preview(files, "/q", AS_OF, 10)


@query(f"WITH {CAT}, g AS (SELECT full_hash, count(*) AS n, any_value(size) AS size FROM cat WHERE size > 0 GROUP BY full_hash HAVING count(*) > 1) SELECT (SELECT count(*) FROM cat) AS files, (SELECT CAST(sum(size) AS BIGINT) FROM cat) AS bytes, (SELECT count(*) FROM g) AS exact_groups, (SELECT CAST(sum(size * (n - 1)) AS BIGINT) FROM g) AS reclaimable")
def stats_row(spark, sf_dir):
    files = insights.totals(catalog.virtual_catalog(spark, sf_dir)).select(F.col("n_files").alias("files"), "bytes", F.lit(1).alias("_k"))
    dup = reclaimable_bytes(spark, sf_dir).select(F.col("n_groups").alias("exact_groups"), F.col("bytes").alias("reclaimable"), F.lit(1).alias("_k"))
    return files.join(dup, "_k").drop("_k")


@query(f"WITH {BITS}, p AS (SELECT distance, x.label = y.label AS same FROM d JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON d.b = y.vec_id) SELECT max(distance) FILTER (same) AS max_intra, min(distance) FILTER (NOT same) AS min_inter, (max(distance) FILTER (same) + min(distance) FILTER (NOT same)) / 2 AS threshold FROM p")
def calibration_threshold(spark, sf_dir):
    """Over all pairs of labelled prints, however far apart."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label")
    return moves.middle(bits.extremes(_vector_prints(spark, sf_dir).join(labels, "id")))


@query(f"WITH {CAT} SELECT path, {HUMAN} AS human, strftime(make_timestamp(CAST(mtime AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM cat")
def size_and_time_labels(spark, sf_dir):
    return catalog.virtual_catalog(spark, sf_dir).select("path", human_size(F.col("size")).alias("human"), iso_time(F.col("mtime")).alias("iso"))


@query()
def dhash_from_pixels(spark, sf_dir):
    ship(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("p"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return rows.select("vec_id", media.pixel_hash("dhash")("p", "h", "w").alias("words"))


@query()
def phash_from_pixels(spark, sf_dir):
    ship(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("p"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return rows.select("vec_id", media.pixel_hash("phash", rotation=True)("p", "h", "w").alias("words"))


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def component_labels(spark, sf_dir):
    """The orders of a customer form a chain, each joined to the next."""
    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy(F.xxhash64("o_orderkey"), "o_orderkey"))
    return connected_components(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), after.alias("b")).where("b is not null"))


ERRORS = f"WITH {CAT}, e AS (SELECT path, 'unreadable' AS error, mtime AS \"at\" FROM cat WHERE doc_id % 17 = 0)"


def _errors(spark, sf_dir) -> DataFrame:
    files = catalog.virtual_catalog(spark, sf_dir)
    return errors.error_log(files.withColumn("text", F.when(F.col("doc_id") % 17 != 0, F.col("content"))), "text", "unreadable", F.col("mtime"))


@query(f"{ERRORS} SELECT * FROM (SELECT path, error, \"at\", CAST(row_number() OVER (ORDER BY \"at\", path) AS INTEGER) AS rank, count(*) OVER () AS n_errors FROM e) WHERE rank <= 500")
def error_list(spark, sf_dir):
    return errors.error_list(_errors(spark, sf_dir))


JUNK = f"WITH {CAT}, junk AS (SELECT path, name, size, mtime FROM cat WHERE name LIKE 'doc_1%' OR name LIKE '%99.txt')"


def _junk(spark, sf_dir) -> DataFrame:
    return catalog.split_junk(catalog.virtual_catalog(spark, sf_dir), ("doc?1*", "*99.txt")).where("junk")


@query(f"{JUNK} SELECT path, size, 'move' AS recommend, CAST(row_number() OVER (ORDER BY size DESC, path) AS INTEGER) AS rank, CAST(sum(size) OVER () AS BIGINT) AS total_bytes FROM junk")
def junk_list(spark, sf_dir):
    return catalog.junk_list(_junk(spark, sf_dir))


@query(f'{FLAT} SELECT *, CAST(row_number() OVER (PARTITION BY category, "group" ORDER BY size_bytes DESC, path) AS INTEGER) AS place FROM flat')
def sorted_groups(spark, sf_dir):
    return export.sorted_groups(_flat(spark, sf_dir), "size", descending=True)


@query(f"{FLAT} SELECT *, role <> 'keeper' AS prechecked FROM flat")
def selection_reset(spark, sf_dir):
    return export.reset_selection(_flat(spark, sf_dir), "all")


def _rows_sql(key: str, source: str) -> str:
    """The export rows of a category over a query group_id, path, size, mtime, role."""
    title, grouped = next((title, grouped) for k, title, grouped in export.CATEGORIES if k == key)
    number = "CAST(dense_rank() OVER (ORDER BY group_id) AS INTEGER)" if grouped else "0"
    return f"""SELECT '{key}' AS category, '{title}' AS category_title, {number} AS "group", CASE role WHEN 'keep' THEN 'keeper' ELSE role END AS role, path,
  regexp_replace(path, '^.*/', '') AS name, regexp_replace(path, '/[^/]*$', '') AS folder, size AS size_bytes, {HUMAN} AS size_human, strftime(make_timestamp(CAST(mtime AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS mtime_iso FROM ({source})"""


NEAR_FILES = f"WITH {CAT}, ng AS ({ORACLE['near_groups']}) SELECT group_id, path, size, mtime, role FROM ng JOIN cat USING (doc_id)"
REPORT = " UNION ALL ".join(
    _rows_sql(key, source)
    for key, source in (
        ("dup", f"{EXACT} SELECT group_id, path, size, mtime, role FROM dup"),
        ("doc", f"{SAME_TEXT} SELECT group_id, path, size, mtime, role FROM st"),
        ("docnear", NEAR_FILES),
        ("junk", f"{JUNK} SELECT path, size, mtime, 'move' AS role FROM junk"),
        ("empty", f"WITH {TREE} SELECT path, 0::BIGINT AS size, {AS_OF} AS mtime, 'item' AS role FROM empty"),
    )
)


@query(REPORT)
def report_rows(spark, sf_dir):
    """The export of several categories, groups and flat ones."""
    files = _texts(spark, sf_dir).select("doc_id", "path", "size", "mtime")
    spaced = materialize(_spaced(spark, sf_dir), "texts")
    same = groups.same_fingerprint(spaced, "txt").join(spaced.select("path", "size", "mtime"), "path")
    near = near_groups(spark, sf_dir).join(files, "doc_id")
    empty = _tree(spark, sf_dir).select("path", F.lit(0).cast("long").alias("size"), F.lit(AS_OF).alias("mtime"))
    return export.all_rows({"dup": exact_duplicates(spark, sf_dir), "doc": same, "docnear": near, "junk": _junk(spark, sf_dir), "empty": empty})


@query(f"SELECT category, count(DISTINCT \"group\") AS n_groups, count(*) AS n_rows FROM ({REPORT}) GROUP BY category")
def report_counts(spark, sf_dir):
    return export.category_counts(report_rows(spark, sf_dir))


@query(f"SELECT category, n_groups, n_rows FROM (SELECT category, count(DISTINCT \"group\") AS n_groups, count(*) AS n_rows FROM ({REPORT}) GROUP BY category) WHERE category NOT IN ('junk', 'empty') ORDER BY n_groups DESC, category LIMIT 1")
def best_category(spark, sf_dir):
    return export.best_category(report_counts(spark, sf_dir))


def _components_sql(pairs: str) -> str:
    return f"WITH RECURSIVE near AS MATERIALIZED ({pairs}), sym AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), {REACH}, comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id) SELECT component FROM comp"


def _n(sql: str, what: str) -> str:
    return f"(SELECT {what} FROM ({sql}))"


COUNTERS = {
    "total_files": ("catalog_scan", "count(*)"), "exact_dup_groups": ("exact_duplicates", "count(DISTINCT group_id)"), "name_conflict_groups": ("name_conflicts", "count(DISTINCT lower_name)"),
    "version_anomaly_groups": ("version_anomalies", "count(DISTINCT family)"), "image_dup_groups": ("image_loose_groups", "count(DISTINCT component)"), "doc_dup_groups": ("doc_groups", "count(DISTINCT group_id)"),
    "zip_dup_groups": ("archive_manifest_groups", "count(DISTINCT manifest)"), "doc_near_groups": ("near_groups", "count(DISTINCT group_id)"), "video_dup_groups": ("video_pairs", "count(DISTINCT component)"),
    "audio_dup_groups": ("ber_clusters", "count(DISTINCT component)"), "archive_loose_count": ("unpacked_archives", "count(*)"), "junk_count": ("junk_list", "count(*)"), "junk_bytes": ("junk_list", "coalesce(max(total_bytes), 0)"),
    "empty_dir_count": ("empty_dirs", "count(*)"), "reclaimable_bytes": ("reclaimable_bytes", "max(bytes)"), "error_count": ("error_list", "coalesce(max(n_errors), 0)"),
}


@query("SELECT " + ", ".join(f"CAST({_n(_components_sql(ORACLE[q]) if q == 'video_pairs' else ORACLE[q], what)} AS BIGINT) AS {name}" for name, (q, what) in COUNTERS.items()))
def stats_counters(spark, sf_dir):
    """All counters of a report in one row."""
    made = {}
    for name, (q, what) in COUNTERS.items():
        rows = bits.clusters(_video_prints(spark, sf_dir), fixed.VIDEO_THRESHOLD) if q == "video_pairs" else QUERIES[q](spark, sf_dir)
        made[name] = rows.agg(F.expr(what).alias("value"))
    return export.stats(made)


@query()
def capability_probe(spark, sf_dir):
    return doctor(spark)
