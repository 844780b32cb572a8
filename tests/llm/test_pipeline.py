"""The pipeline as a whole against a plain brute-force version of its five stages."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from cairn.llm import quality_rules

BLANKS = " \t\n\x0b\x0c\r"
DOC = "doc_id long, text string, lang string, source string, n_chars long, did string, q_kept int, q_words string, q string, doc int"


def fixture_rows():
    """Clean, noisy, short, copied, nearly copied and leaked documents, shared lines, nulls and repeated rows."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(n))
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((14, 25, 10, 6))] + [(90, None), (None, ""), (91, "...")]
    texts, labels = [], []
    for i in range(1, 121):
        text = prose(rng.randint(6, 14))
        if i % 5 == 0:
            text = " ".join(w + "#$" * (k % 3 == 0) for k, w in enumerate(text.split(" ")))
        if i % 7 == 0:
            text = text + "\nThis Line Is Under License Terms \ntail"
        if i % 11 == 0:
            text = text + "\n" + items[i % 4][1].upper().replace(" ", ", ")
        texts.append([i, text])
        labels.append((i, int(i % 5 != 0), 0))
    clean = [t for i, t in texts if i % 5 and i % 7 and i % 11]
    for k, i in enumerate(range(121, 171)):
        words = clean[k % 9].split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        # One word a line, so that only the third stage sees the copy.
        texts.append([i, "\n".join(" ".join(words).split())])
    texts += [[171, None], [172, ""], [173, " \t\n "], [174, prose(2)], [175, "one two three " * 40], [176, "é" * 30_000], [177, prose(900)], [None, prose(9)], [None, clean[1]], [None, "document number 155687\n" + prose(8)], [None, "document number 11912\n" + prose(8)], [178, clean[0]], [178, clean[0]]]
    sources = [*["hot"] * 6, "web", "Web", "ärger", None]
    return [(i, t, "en", sources[n % len(sources)], None if t is None else len(t), "x", n % 2, "w", "q", n) for n, (i, t) in enumerate(texts)], labels, items


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_quality(rows, rules):
    kept = []
    for row in rows:
        text, w = row[1] or "", words_of(row[1])
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {p + d for p, win in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[win] > 1 for d in range(3)}
        lines, chars, n = [x for x in text.split("\n") if words_of(x)], sum(map(len, w)), len(w)
        if n < 50 or 100 * len(twice) > 50 * n:
            continue
        have = {
            "n_words": n, "mean_word": chars / n, "symbols_per_word": sum(map(text.count, "#*$%&|<>")) / n, "dup_lines_per_line": (len(lines) - len(set(lines))) / len(lines),
            "repeat_words": len(twice) / n, "upper_share": sum("A" <= c <= "Z" for c in text) / chars, "bang_per_word": text.count("!") / n, "distinct_share": len(set(w)) / n,
        }
        if not any(all((have[c.feature] > c.threshold) == c.above for c in r.conditions) for r in rules):
            kept.append(row)
    return kept


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def by_id(row):
    """Rows without doc_id come first, each text a document of its own."""
    return row[0] if row[0] is not None else -(2**63) + (xxhash.xxh64_intdigest((row[1] or "").encode(), xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)) >> 2)


def brute_lines(rows):
    key = lambda line: low(line.strip(BLANKS))
    holders = defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(by_id(row))
    cut = lambda r: "\n".join(x for x in r[1].split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == by_id(r))
    texts = [None if r[1] is None else cut(r) for r in rows]
    return [(r[0], t, *r[2:4], r[4] if t is None else len(t), *r[5:]) for r, t in zip(rows, texts, strict=True)]


def brute_near(rows):
    sets = []
    for row in rows:
        w = words_of(low(row[1] or ""))
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    least = {n: n for n in range(len(rows))}

    def find(n):
        while least[n] != n:
            n = least[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)), key=lambda n: (rows[n][0] is None, by_id(rows[n]), n))
                least[y] = x
    return [r for n, r in enumerate(rows) if by_id(r) == by_id(rows[find(n)])]


def brute_clean(rows, items):
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    windows = set()
    for _, text in items:
        w = words(text)
        windows |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))
    return [r for r in rows if not hit(words(r[1]))]


def brute_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, target, total = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, sum(sizes.values())
    while free := [s for s in order if s not in target]:
        left, heavy = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] >= 3 * sizes[s] * heavy]
        target |= {s: 3 * sizes[s] for s in over} if over else {s: left * weight[s] / heavy for s in free}

    def key(row):
        h = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
        h = h if row[0] is None else xxhash.xxh64_intdigest(row[0].to_bytes(8, "little"), h)
        h = h if row[1] is None else xxhash.xxh64_intdigest(row[1].encode(), h)
        return (h >> 1, h - (1 << 64) * (h >> 63), (row[0] is not None, row[0] or 0))

    out = []
    for s in order:
        rounds, rest = divmod(int(target[s]), sizes[s]) if sizes[s] else (0, 0)
        for r in sorted((r for r in rows if r[3] == s), key=key):
            n = len(words_of(r[1]))
            part = min(n, rest)
            rest -= part
            if n * rounds + part:
                out.append((r[0], s, n, sizes[s], round(target[s], 6), n * rounds + part))
    return out


def test_pipeline(spark, tmp_path):
    rows, labels, items = fixture_rows()
    for name, data, kind in (("documents", rows, DOC), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rules = quality_rules.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules
    brute = (lambda x: brute_quality(x, rules), brute_lines, brute_near, lambda x: brute_clean(x, items))
    want, counts = rows, [len(rows)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute, strict=False):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [x.split()[0] for x in DOC.split(", ")]
        before, want = want, plain(want)
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(map(tuple, want), key=str), name
        assert docs.where("n_chars != char_length(text) or (n_chars is null) != (text is null)").count() == 0, name
        assert want != before, name
        counts.append(len(want))
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[4] < counts[3] < counts[2]
    got = [(r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute_mix(want), key=str)


@pytest.mark.parametrize("missing", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, missing):
    rows, labels, items = fixture_rows()
    for name, data, kind in (("documents", rows[:12], DOC), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame([] if name == missing else data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert n == 0 if missing == "documents" else n > 0
