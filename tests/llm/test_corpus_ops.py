"""Deduplication, fingerprints, quality and the pipeline against brute force and planted cases."""

import hashlib
import os
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carepath.llm import common, edit_fingerprint, exact_dedup, near, ngram_join, quality, queries, shingles, substring_dedup
from carepath.llm.components import components

EXTRA = "lines string, words int, id string, kept string, rank string, score double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def with_extras(spark, rows):
    """(doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "l", 1, None, "k", "r", 0.5) for i, t in rows], "doc_id long, text string, " + EXTRA)


def edges_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    n = 60
    pairs = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], "chain": [(k, k + 1) for k in range(n - 1)], "star": [(n - 1, k) for k in range(n - 1)], "none": []}[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + pairs[:3], "a long, b long")).collect()}
    want = edges_of(n, pairs)
    assert got == {k: want[k] for k in {x for a, b in pairs if a != b for x in (a, b)}}


def test_words_are_read_as_they_stand():
    rng = random.Random(5)
    texts = ["", "\u0391\u03a3 \u03b1\u03c3 --- a\n\nb", "x" * 40000 + " y " + "Z" * 33000 + "!", " ", "a\x1cb\x85c d'e (f) _", "\u65e5\u672c \u8a9e\u3002", words(rng, 30000)]
    got, seen, k, line = shingles.read_words(texts), {}, 0, 0
    for n, text in enumerate(texts):
        assert got.first_line[n] == line
        for m in re.finditer(r"\S+", text):
            assert (got.text[k], got.start[k], got.end[k], got.line[k]) == (n, *m.span(), line + text[: m.start()].count("\n"))
            word = re.sub(r"^[\W_]+|[\W_]+$", "", m[0].lower().replace("\u03c2", "\u03c3"))
            assert (got.hash[k] == 0) == (word == "") and seen.setdefault(word, got.hash[k]) == got.hash[k]
            k += 1
        line += text.count("\n") + 1
    assert k == len(got.text) and line == got.lines and len(set(seen.values())) == len(seen)


def test_bands_reach_their_recall():
    for s, recall in ((0.8, 0.9995), (0.8, 0.98), (0.5, 0.9)):
        b, r = shingles.choose_bands(s, recall, 256)
        assert 1 - (1 - s**r) ** b >= recall
    rng = np.random.default_rng(0)
    b, r = shingles.choose_bands(0.8, 0.98)
    hits = 0
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        a, c = base[:85], np.r_[base[:75], base[85:]]  # Jaccard 75 / 90 + ...
        keys = shingles.band_keys(np.r_[a, c], np.array([len(a), len(c)]), b, r)
        hits += bool((keys[0] == keys[1]).any())
    assert hits >= 190


def near_corpus():
    rng = random.Random(8)
    rows = [(k, words(rng, rng.randint(1, 120))) for k in range(60)]
    for k in range(60, 150):  # near copies of a few texts, with up to three edits
        w = rows[k % 12][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((k, " ".join(w)))
    hot = words(rng, 200).split()
    for k in range(150, 190):  # a large group
        w = list(hot)
        w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((k, " ".join(w).upper() if k % 2 else " ".join(w) + "."))
    rows += [(200, ""), (201, None), (202, " \n"), (203, "..."), (204, "one two"), (205, "One, two!"), (206, "one two three"), (5, rows[5][1]), (None, rows[5][1])]
    return rows


def brute_sets(text, n=5):
    w = text.split()
    return [tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]


def brute_links(rows, similarity=0.8, n=5):
    sets = []
    for _, t in rows:
        w = [x for x in (re.sub(r"^[^\w]+|[^\w]+$", "", x.lower()) for x in (t or "").split()) if x]
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((b, a))
    return pairs


@pytest.mark.parametrize("limit", [1 << 24, 2000, 64])
def test_sets_are_compared_part_by_part(monkeypatch, limit):
    monkeypatch.setattr(near, "BYTES", limit)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [np.unique(np.r_[base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 6))).astype(np.uint64)]) for _ in range(30)]
    ask = np.triu(rng.random((30, 30)) < 0.7, 1)
    got = near.jaccard_verifier(0.8)([s.tobytes() for s in sets], ask)
    want = [[ask[a, b] and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for b in range(30)] for a in range(30)]
    assert (got == np.array(want)).all() and 0 < got.sum() < ask.sum()


@pytest.mark.parametrize("block", [512, 7])
def test_ngram_join_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = near_corpus()
    ids = [(i, t) for i, t in rows if i is not None]
    pairs = brute_links(ids)
    counts = Counter(k for p in pairs for k in p)
    root = edges_of(len(ids), pairs)
    least = {c: min(ids[k][0] for k in range(len(ids)) if root[k] == c) for c in set(root)}
    size = Counter(root)
    want = sorted((i, least[root[k]], size[root[k]], counts[k]) for k, (i, _) in enumerate(ids))
    got = sorted((r.doc_id, r.class_id, r.class_size, r.n_links) for r in ngram_join.ngram_join(with_extras(spark, rows)).collect())
    assert got == want


def test_ngram_dedup_keeps_one_of_each_group(spark):
    docs = with_extras(spark, near_corpus())
    classes = {r.doc_id: r.class_id for r in ngram_join.ngram_join(docs).collect()}
    kept = ngram_join.ngram_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id not in (5, None)) == Counter({c for c in classes.values() if c != 5})
    assert kept.where("doc_id is null").count() == 1
    assert ngram_join.ngram_join(docs.where("false")).count() == 0


def test_exact_dedup(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, "a\xa0b"), (5, None), (6, ""), (7, " \t"), (8, "x"), (8, "x"), (9, "AB"), (None, "q"), (10, "q"), (None, "solo")]
    docs = with_extras(spark, rows)
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:4]
    assert got[3, sha("ab")] == (2, 3, False) and got[1, sha("ab")] == (2, 3, False) and got[2, sha("ab")] == (2, 3, True)
    assert got[4, sha("a\xa0b")] == (4, 1, True) and got[9, sha("AB")] == (9, 1, True)
    assert got[5, sha("")] == (7, 3, False) and got[7, sha("")] == (7, 3, True)
    assert got[8, sha("x")] == (8, 2, True) and got[10, sha("q")] == (10, 2, True)
    assert len(exact_dedup.exact_groups(docs).collect()) == len(rows)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, 7, 8, 8, 9, None, 10, None])
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def test_exact_dedup_of_hot_groups_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 7)
    long = "long text " * 200_000
    rows = [(k, "hot" + " " * (k % 5)) for k in range(400)] + [(1000 + k, f"warm {k % 30}") for k in range(240)] + [(2000 + k, long + " " * k) for k in range(9)]
    rows += [(3000 + k, f"cold {k}") for k in range(50)] + [(5, "hot"), (None, "hot")]
    got = exact_dedup.exact_groups(with_extras(spark, rows)).collect()
    groups = {}
    for k, text in rows:
        groups.setdefault("".join(text.split()), []).append((-len(text), k if k is not None else 1 << 62))
    want = Counter()
    for key, members in groups.items():
        n, least = min(members)
        want.update((k if k < 1 << 62 else None, least, len(members), (m, k) == (n, least), hashlib.sha256(key.encode()).hexdigest()) for m, k in members)
    assert Counter(map(tuple, got)) == want


def test_no_text_is_lost_where_an_id_has_two_texts(spark):
    rng = random.Random(8)
    a, b = words(rng, 50), words(rng, 50)
    docs = with_extras(spark, [(5, a), (5, b), (3, b), (7, a), (9, "alone")])
    for dedup in (exact_dedup.exact_dedup, ngram_join.ngram_dedup):
        assert Counter((r.doc_id, r.text) for r in dedup(docs).collect()) == Counter([(5, a), (5, b), (3, b), (9, "alone")])


@pytest.fixture(scope="module")
def passages():
    """Passages of 51 words that documents share, at line starts or within lines; clean documents; oddities."""
    rng = random.Random(1)
    shared = [words(rng, 51) for _ in range(20)]
    rows = []
    for k in range(160):
        p = shared[k % 20] if k < 60 else ""
        rows.append((k, words(rng, rng.randint(5, 120)) + (" " if k % 2 else "\n") + p + (" " if k % 3 else "\n") + words(rng, rng.randint(5, 120))))
    rows += [(200, None), (201, ""), (202, "Is it. " * 400), (203, "Is it. " * 400 + words(rng, 30)), (None, rows[0][1]), (204, "short line\n" * 3), (205, "short line\n" * 3)]
    return SimpleNamespace(shared=shared, rows=rows)


def test_substring_dedup_finds_every_shared_passage(spark, passages):
    docs = with_extras(spark, passages.rows)
    got = {r.doc_id: r for r in substring_dedup.substring_spans(docs).collect()}
    assert sorted(got) == [*range(20, 60), 203]
    # documents with smaller ids that hold the passage; the first of them keeps it
    assert all(got[k].keep_doc_ids[0] == k % 20 and all(i < k and i % 20 == k % 20 for i in got[k].keep_doc_ids) for k in range(20, 60))
    assert all(r.removed_chars >= len(passages.shared[k % 20]) for k, r in got.items() if k < 100)
    texts = dict(passages.rows)
    for k, r in got.items():
        assert r.removed_chars == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans)
        kept = set(brute_sets(texts[r.keep_doc_ids[0]]))
        for s in r.spans:  # a passage, or a line of which that is nearly all
            grams = brute_sets(texts[k][s.start : s.end])
            assert len(kept & set(grams)) >= 0.75 * len(set(grams))
    new = substring_dedup.substring_dedup(docs)
    assert new.columns == docs.columns
    after = {r.doc_id: r.text for r in new.collect() if r.doc_id is not None}
    for k in range(160):
        assert (after[k] == texts[k]) == (k not in got)
        assert (passages.shared[k % 20] in after[k]) == (k < 20)
    assert new.count() == docs.count() and substring_dedup.substring_spans(docs.where("false")).count() == 0


def test_near_duplicate_lines_are_cut(spark):
    rng = random.Random(5)
    line = words(rng, 120).split()
    rows = []
    for k in range(6):
        w = list(line)
        w[10 * k + 5] = words(rng, 1)
        rows.append((k, words(rng, 60) + "\n" + " ".join(w) + "\n" + words(rng, 40)))
    pairs = brute_links([(k, t.split("\n")[1]) for k, t in rows])
    assert pairs
    cut = {r.doc_id: r for r in substring_dedup.substring_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = edges_of(6, pairs)
    assert {k for k in range(6) if root[k] != k} <= set(cut)


def test_spans_and_cuts():
    text = "one two\nthree four five\nsix"
    cut = lambda t, lines, *ranges: substring_dedup.spans_of(["x y", t, ""], [[], lines, []], [[], [(a << 32) + b for a, b in ranges], []])
    assert cut(text, [1]) == [[], [(8, 23)], []]
    assert cut(text, [2], (0, 1), (1, 2), (2, 3)) == [[], [(0, 13), (24, 27)], []]
    assert cut("- a . b", [], (0, 1), (1, 2)) == [[], [(2, 7)], []]
    assert substring_dedup.without(text, [(8, 23)]) == "one two\nsix"
    assert substring_dedup.without(text, [(0, 27)]) == ""
    assert substring_dedup.without("a b c", [(4, 5)]) == "a b"
    assert cut("a b", [5], (0, 36)) == [[], [], []]


def slow_walk(text):
    place, out = 0, [0]
    for c in edit_fingerprint.classes(text).tolist():
        place += edit_fingerprint.ROWS[c][place % edit_fingerprint.PERIOD]
        out.append(place)
    return out


def test_walks_go_step_by_step():
    rng = random.Random(3)
    texts = ["", "a", "é🙂", *("".join(rng.choice("abc dé的") for _ in range(rng.randint(0, 900))) for _ in range(70)), "ab" * 9000]
    x = [edit_fingerprint.classes(t) for t in texts]
    assert [p.tolist() for p in edit_fingerprint.walk(x, np.zeros(len(x), np.int64))] == [slow_walk(t) for t in texts]


def test_edits_keep_the_embedding_close():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    close = text[:1000] + "xyz" + text[1002:2500] + text[2504:]
    other = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    a, b, c = edit_fingerprint.fingerprints([text, close, other])
    assert edit_fingerprint.likeness(a, b) > 0.6 > 0.3 > edit_fingerprint.likeness(a, c)
    assert edit_fingerprint.likeness(a, a) == 1.0 == edit_fingerprint.likeness(a[:0], a[:0])


def test_fingerprint_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_001, None), (10_002, ""), (10_003, "é🙂x"), (None, "null id")]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in edit_fingerprint.fingerprint_documents(with_extras(spark, random.Random(1).sample(rows, len(rows)))).collect()}
    assert len(got) == len(rows)
    marks = [edit_fingerprint.fingerprints([t or ""])[0] for _, t in rows]
    for k, (doc, text) in enumerate(rows):
        after = (k + 1) % len(rows)
        new = edit_fingerprint.edited(text or "", rows[after][1] or "")
        other = edit_fingerprint.fingerprints([new])[0]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text or ""), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (edit_fingerprint.shown(marks[k]), edit_fingerprint.shown(other))
        assert r.near_edited == edit_fingerprint.likeness(marks[k], other) and r.near_next == edit_fingerprint.likeness(marks[k], marks[after])
    big = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in big]) > 0.95
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert edit_fingerprint.fingerprint_documents(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert edit_fingerprint.fingerprint_documents(one.where("false")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def test_edit_similarity_is_the_distance_s():
    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", "a", "bc"])
        b, least = "".join(b), rng.choice([0.5, 0.7, 0.8, 0.9])
        assert edit_fingerprint.edit_similarity(a, b, least) == (edit_distance(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9))


def test_edit_near_finds_planted_pairs(spark):
    rng = random.Random(7)
    rows = [(k, words(rng, 100)) for k in range(40)]
    rows += [(100 + k, rows[k][1][: 40 * k] + "ZZ" + rows[k][1][40 * k + 1 :]) for k in range(10)] + [(200, ""), (201, None), (None, "x")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in edit_fingerprint.edit_near(with_extras(spark, rows)).collect()}
    assert sum(got[100 + k] == (k, 1) for k in range(10)) >= 9
    assert all(got[k] == (k, 0) for k in (*range(10, 40), 200, 201)) and None not in got


def test_isotonic_pools_violators():
    assert quality.isotonic(np.arange(4.0), np.array([1.0, 1, 1, 2]), np.array([0.0, 1, 0, 0.5])).tolist() == [0.0, 0.5, 0.5, 0.5]


def test_isotonic_is_the_min_max_formula():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40):
        weight, value = rng.integers(1, 6, n).astype(float), rng.integers(0, 5, n) / 4
        mean = lambda j, k: (weight * value)[j : k + 1].sum() / weight[j : k + 1].sum()
        want = [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        assert np.allclose(quality.isotonic(np.arange(n * 1.0), weight, value), want)


def test_fit_is_the_direct_solution(spark):
    rng, d = np.random.default_rng(6), len(quality.STATISTICS)
    x = rng.normal(size=(600, d)) * rng.uniform(0.1, 3, d) + 1
    y = (x[:, 0] - x[:, 1] ** 2 / 9 + rng.normal(size=600) > 0).astype(float)
    part = np.arange(600) % 4 + 1
    rows = [(k, x[k].tolist(), float(y[k]), int(part[k])) for k in range(600)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, x array<double>, y double, fold int").repartition(7))
    train = part != 4
    assert np.allclose(model.mean, x[train].mean(0)) and np.allclose(model.scale, x[train].std(0), atol=2e-6)
    z = np.cos((x - model.mean) / model.scale @ model.turn + model.shift)
    # ridge as least squares with a row for each penalised weight; the constant has no penalty to speak of
    a = np.vstack([np.c_[z[train], np.ones(train.sum())], np.c_[np.sqrt(quality.RIDGE) * np.eye(quality.FEATURES), np.zeros(quality.FEATURES)]])
    weights = np.linalg.lstsq(a, np.r_[y[train], np.zeros(quality.FEATURES)], rcond=None)[0]
    raw = np.c_[z, np.ones(600)] @ weights
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    # calibration: bins of the fourth fold's raw scores, each with a share of one row of each label
    at = np.clip(((raw[~train] + 1) / 3 * quality.BINS).astype(int), 0, quality.BINS - 1)
    has = np.unique(at)
    count, good = (np.array([v[at == k].sum() for k in has]) for v in (np.ones((~train).sum()), y[~train]))
    share = (good + 1 / len(has)) / (count + 2 / len(has))
    assert np.allclose(model.level, quality.isotonic(has, count + 2 / len(has), share)) and (np.diff(model.level) >= 0).all()
    assert np.allclose(model.score(x), np.interp(raw, (has + 0.5) / quality.BINS * 3 - 1, model.level), atol=1e-5)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97 and np.mean([r.predicted for r in rows if r.quality == 0]) < 0.15
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    same = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(same[r.doc_id] == r.score for r in rows)  # held-out labels do not matter


def test_quality_on_odd_rows(spark):
    docs = with_extras(spark, [(1, None), (2, ""), (None, "a b"), (3, "x " * 5000), (3, "again")])
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (77, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    none = quality.quality_scores(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.quality_filter(docs, labels.where("false")).columns == docs.columns


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        out = stage(spark, now, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        now = spark.createDataFrame(out.toPandas(), out.schema)
        seen.append((name, before, now))
    by = {n: (b, a) for n, b, a in seen}
    before, after = by["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    texts = [norm(r.text) for r in after.collect()]
    assert len(set(texts)) == len(texts) and set(texts) == {norm(r.text) for r in before.collect()}
    before, after = by["ngram_jaccard"]
    rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    root = edges_of(len(rows), brute_links(rows))
    assert {r.doc_id for r in after.collect()} == {rows[k][0] for k in set(root)}
    before, after = by["substring_dedup"]
    old = {r.doc_id: r.text for r in before.collect()}
    assert all(len(r.text) <= len(old[r.doc_id]) and r.n_chars == len(r.text) for r in after.collect())
    before, after = by["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    run = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())
    assert {r[0] for r in run} == {r.doc_id for r in after.collect()}
    assert sum(r[2] for r in run) == sum(r.length for r in after.collect())


def test_every_operator_has_its_query(spark, sf_dir):
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    for f in queries.QUERIES.values():
        assert f(spark, sf_dir).count() > 0



def test_lines_of_documents_with_any_long_id_are_cut(spark):
    rng = random.Random(6)
    line = words(rng, 120).split()
    rows = []
    for k, doc in enumerate((-(2**63), -(2**50), 7, 2**39 + 1, 2**63 - 1)):
        w = list(line)
        w[20 * k + 5] = words(rng, 1)
        rows.append((doc, words(rng, 60) + "\n" + " ".join(w) + "\n" + words(rng, 40)))
    got = substring_dedup.paragraph_clusters(spark.createDataFrame(rows, "id long, text string")).select("id", "line", "keep_id", "keep_line").collect()
    pairs = brute_links([(k, t.split("\n")[1]) for k, (_, t) in enumerate(rows)])
    root = edges_of(5, pairs)
    want = {(rows[k][0], 1, rows[root[k]][0], 1) for k in range(5) if root.count(root[k]) > 1}
    assert want and {tuple(r) for r in got} == want


def test_paragraphs_of_any_length_are_cut(spark):
    rng = random.Random(7)
    short, wrapped = words(rng, 12), words(rng, 70).split()
    rows = []
    for k in range(4):
        w = list(wrapped)
        w[35] = words(rng, 1)  # no run of 51 equal words
        own = lambda: words(rng, 30)
        lines = "\n".join(" ".join(w[a : a + 11 + k]) for a in range(0, 70, 11 + k))
        rows.append((k, own() + "\n" + (short if k % 2 else short.upper() + ".") + "\n" + own() + "\n\n" + lines + "\n\n" + own()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    long_ones = {r.doc_id: r for r in substring_dedup.substring_spans(docs).collect()}
    got = {r.doc_id: r for r in substring_dedup.substring_spans(docs, cut_words=5).collect()}
    assert sorted(got) == [1, 2, 3]
    for k, r in got.items():
        text = rows[k][1]
        gone = [text[s.start : s.end] for s in r.spans]
        assert len(gone) == 2 and gone[0].lower().strip(".") == short
        assert len(gone[1].split()) == 70 and r.keep_doc_ids == [0]
        assert long_ones[k].spans == r.spans[1:]  # a short line is found, and stays
    found = substring_dedup.paragraphs(shingles.read_words(["a b\nc d\n\n1 2 3 4 5", "1 2 3\n1 2 3 4 5"]))
    assert list(zip(*(x.tolist() for x in found))) == [(3, 3, 5), (5, 5, 5), (4, 5, 8)]


def test_runs_go_whole_where_a_document_repeats_them_or_a_smaller_id_has_a_part(spark):
    rng = random.Random(9)
    own = lambda: words(rng, 40)
    rows = []
    for n in range(8):  # winnowed windows fall differently in each
        p, run = words(rng, 60), words(rng, 80).split()
        rows += [(10 * n, f"{own()} {p} {own()}"), (10 * n + 1, f"{own()} {p} {own()} {p} {own()} {p} {own()}")]
        rows += [(10 * n + 2, f"{own()} {' '.join(run[20:60])} {own()}")]
        rows += [(10 * n + k, f"{own()} {' '.join(run)} {own()}") for k in (3, 4)]
    got = {r.doc_id: r for r in substring_dedup.substring_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for n in range(8):
        r = got[10 * n + 1]
        assert [len(texts[10 * n + 1][s.start : s.end].split()) for s in r.spans] == [60, 60, 60]
        r = got[10 * n + 4]
        assert [len(texts[10 * n + 4][s.start : s.end].split()) for s in r.spans] == [80]
        assert 10 * n + 3 in r.keep_doc_ids


def edited_letters(rng, text, share):
    out = []
    for c in text:
        kind = rng.randrange(3) if rng.random() < share else None
        other = chr(97 + rng.randrange(26))
        out.append(c if kind is None else "" if kind == 0 else other if kind == 1 else other + c)
    return "".join(out)


@pytest.mark.parametrize("size", [40, 500, 5000])
def test_edit_bands_recall_at_any_length(size):
    rng = random.Random(size)
    hits = 0
    for k in range(40):
        text = "".join(chr(97 + rng.randrange(26)) for _ in range(size))
        other = edited_letters(rng, text, (0.05, 0.1, 0.2)[k % 3])
        a, b = (edit_fingerprint.near_keys(edit_fingerprint.classes(t), 64, 10) for t in (text, other))
        hits += bool((a == b).any())
    assert hits >= 38


def test_edit_near_links_long_and_short_texts(spark):
    rng = random.Random(12)
    rows = []
    for k in range(9):
        text = "".join(chr(97 + rng.randrange(26)) for _ in range((40, 500, 3000)[k % 3]))
        rows += [(2 * k, text), (2 * k + 1, edited_letters(rng, text, 0.15))]
    got = {r.doc_id: r for r in edit_fingerprint.edit_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    similar = [k for k in range(9) if edit_fingerprint.edit_similarity(texts[2 * k], texts[2 * k + 1], 0.8)]
    assert len(similar) >= 7
    assert {k for k in range(9) if got[2 * k + 1].class_id == 2 * k and got[2 * k].n_links == 1} == set(similar)


def test_the_pipeline_leaves_other_tables_alone(spark, sf_dir):
    docs = spark.createDataFrame(near_corpus(), "doc_id long, text string")
    mine = ngram_join.ngram_join(docs)
    planned = sorted(map(tuple, mine.collect()))
    corpus_pipeline.run(spark, sf_dir).count()
    for _, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count()
    assert sorted(map(tuple, mine.collect())) == planned
    with common.scratch(spark) as paths:
        assert ngram_join.ngram_join(docs).count() and paths
        files = [p.removeprefix("file://") for p in paths]
        assert any(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))


def test_pipeline_on_odd_rows(spark, sf_dir):
    rng = random.Random(11)
    good = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 400 and 900").limit(6).collect()]
    rows = [(k, t) for k, t in enumerate(good)] + [(0, good[0]), (50, good[1]), (60, None), (61, ""), (None, good[2]), (None, None), (70, words(rng, 60_000)), (71, "\n" * 3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, None, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rank string, h int, payload string, words int")
    for now in (docs, docs.where("false")):
        empty = now is not docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns
            now = spark.createDataFrame(out.collect(), out.schema)
            assert now.isEmpty() or not empty
            if name == "exact_dedup" and not empty:
                assert now.where("doc_id = 50").isEmpty()
        assert empty or sum(r.length for r in now.collect()) > 0


def plain_words(text):
    """(word, start, end) as the operators on words read them, for texts of ASCII."""
    found = ((re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", m.group().lower()), *m.span()) for m in re.finditer(r"\S+", text))
    return [x for x in found if x[0]]


def slow_paragraphs(text):
    lines = text.split("\n")
    size = [len(x.split()) for x in lines]
    out = [(k, k) for k, n in enumerate(size) if n >= 5]
    k = 0
    while k < len(lines):
        m = k
        while m < len(lines) and size[m]:
            m += 1
        if m - k > 1 and (max(size[k:m]) >= 5 or sum(size[k:m]) >= 36):
            out.append((k, m - 1))
        k = max(m, k + 1)
    return [(a, b, sum(size[a : b + 1]), "\n".join(lines[a : b + 1])) for a, b in out]


def slow_cuts(texts, passage, cut_words=36):
    """The places of each text's characters that go, white space aside: every pair of paragraphs is compared, and every passage."""
    gone = {d: set() for d in texts}
    paras = [(d, *p) for d, t in sorted(texts.items()) for p in slow_paragraphs(t)]
    read = [" ".join(w for w, _, _ in plain_words(p[4])) for p in paras]
    sets = [set(brute_sets(x)) if x else set() for x in read]
    label = list(range(len(paras)))
    for a in range(len(paras)):
        for b in range(a):
            if sets[a] and sets[b] and label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    first = {}
    for k, p in enumerate(paras):
        first[label[k]] = min(first.get(label[k], p[:2]), p[:2])
    for k, (d, a, b, n, _) in enumerate(paras):
        if sets[k] and n >= cut_words and first[label[k]][0] != d:
            lines = texts[d].split("\n")
            at = sum(len(x) + 1 for x in lines[:a])
            gone[d] |= set(range(at, at + len("\n".join(lines[a : b + 1]))))
    keep = {}
    listed = {d: plain_words(t) for d, t in sorted(texts.items())}
    for d, ws in listed.items():
        for k in range(len(ws) - passage + 1):
            keep.setdefault(tuple(w for w, _, _ in ws[k : k + passage]), d)
    for d, ws in listed.items():
        for k in range(len(ws) - passage + 1):
            if keep[tuple(w for w, _, _ in ws[k : k + passage])] < d:
                gone[d] |= set(range(ws[k][1], ws[k + passage - 1][2]))
    return {d: {x for x in xs if not texts[d][x].isspace()} for d, xs in gone.items()}


@pytest.fixture(scope="module")
def shared_runs():
    """Texts that share runs of 8 to 90 words, in other cases and with other marks, whole lines and lines with a word changed."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    runs = [some(n) for n in range(8, 91, 3)]
    lines = [some(n) for n in (4, 6, 30, 40, 100, 120)]
    dress = lambda ws: " ".join(rng.choice([w, w, w.title(), w + ",", f"({w})", w + "\n", "- " + w]) for w in ws)
    texts = {}
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.35:
                run = rng.choice(runs)
                a = rng.randint(0, len(run) // 3)
                parts.append(dress(some(rng.randint(0, 9)) + run[a:] + some(rng.randint(0, 9))))
            elif kind < 0.6:
                line = list(rng.choice(lines))
                if rng.random() < 0.5:
                    line[rng.randrange(len(line))] = "changed"
                parts.append("\n" + " ".join(line) + "\n")
            else:
                parts.append(dress(some(rng.randint(1, 60))) + rng.choice(["\n", "\n\n", " "]))
        texts[d * 7 - 100] = "".join(parts)
    return texts


@pytest.mark.parametrize(("window", "passage", "cut_words"), [(1, 36, 36), (1, 12, 5), (16, 36, 36), (4, 12, 5)])
def test_substring_dedup_is_brute_force(spark, shared_runs, window, passage, cut_words):
    docs = spark.createDataFrame([*shared_runs.items(), (None, "no id " * 60)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in substring_dedup.substring_spans(docs, cut_words, window, passage).collect()}
    got = {d: {x for s in rows[d].spans for x in range(s.start, s.end) if not t[x].isspace()} if d in rows else set() for d, t in shared_runs.items()}
    most = slow_cuts(shared_runs, passage, cut_words)
    assert sum(map(len, most.values())) > 1000 and all(k < d for d, r in rows.items() for k in r.keep_doc_ids)
    if window == 1:  # the exact way
        assert got == most
    else:
        least = slow_cuts(shared_runs, passage + window - 1, cut_words)
        assert all(least[d] <= got[d] <= most[d] for d in got)
    kept = {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs.where("doc_id is not null"), cut_words, window, passage).collect()}
    left = lambda d: "".join(c for x, c in enumerate(shared_runs[d]) if x not in got[d] and not c.isspace())
    assert {d: re.sub(r"\s", "", t) for d, t in kept.items()} == {d: left(d) for d, t in shared_runs.items() if left(d)}


def test_words_that_are_equal_under_one_hash_alone_are_told_apart():
    rng = np.random.default_rng(4)
    a = rng.integers(1, 1 << 63, (2, 60)).astype(np.uint64)
    b = a.copy()
    b[1, 30] += np.uint64(1)  # one word differs in its second hash alone
    (_, at, one, two), (_, at2, one2, two2) = (substring_dedup.anchors(x, np.array([60])) for x in (a, b))
    assert len(at) and (at == at2).all() and (one == one2).all() and (two != two2).all()
    same, zero = np.array([7], np.uint64), np.array([0])
    keys = [substring_dedup.context_keys(x, zero, np.array([24]), same, same, 1, 15, 24)[0] for x in (a, b)]
    equal = (keys[0] == keys[1]).all(2)[0]
    assert equal[:6].all() and not equal[6:].any()  # the words after the passage are those from 24 on


def test_both_hashes_of_words():
    bits = "a"
    for _ in range(12):
        bits += bits.translate(str.maketrans("ab", "ba"))
    texts = [bits, bits.translate(str.maketrans("ab", "ba")), "Some words, some Words; x" + "y" * 1023 + " x" + "y" * 1024]
    found = shingles.read_words(texts, both=True)
    known, sizes = shingles.both_hashes(texts)
    assert sizes.tolist() == [1, 1, 6] and known.shape == (2, 8) and (known[0] == shingles.read_words(texts).hash).all()
    assert len(set(found.hash.tolist())) == len(set(found.other.tolist())) == 6  # "some" and "words" twice each
    assert not set(found.hash.tolist()) & set(found.other.tolist())
    alone = [shingles.both_hashes([w])[0][:, 0].tolist() for t in texts for w in t.split()]
    assert alone == known.T.tolist()


def slow_embedding(text):
    """The embedded string, place by place: a character is written until a random bit of the place and the character says go on."""
    bits = np.random.default_rng(edit_fingerprint.SEED).integers(0, 2, (256, 4096), np.int8)
    bits[:, 2047] = 1
    number = lambda c: ord(c) if ord(c) < 256 else (ord(c) * 0x9E3779B1 % 2**32) >> 24
    x, out, k = [number(c) for c in text], [], 0
    while k < len(x):
        c, place = x[k], len(out)
        out.append(c)
        k += int(bits[c, place % 2048])
    return out


def octave_of(place):
    return (place + 1).bit_length() - 1


def test_fingerprints_are_samples_of_the_embedded_string():
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghij klmn") for _ in range(6000))
    texts = ["", "a", "é🙂x的", base[:37], base[:1500], base[:700] + "XYZ" + base[705:1500], base, base[:2999] + base[3001:], base[::-1], "b" * 5000]
    full = [slow_embedding(t) for t in texts]
    places = edit_fingerprint.PLACES.tolist()
    per = Counter(map(octave_of, places))
    assert places == sorted(places) and all(per[o] == min(1 << o, 24) for o in range(34))
    marks = edit_fingerprint.fingerprints(texts)
    digit = lambda c: "0123456789abcdef"[int(edit_fingerprint.NIBBLE[c])]
    shown = [edit_fingerprint.shown(m) for m in marks]
    assert shown == ["".join(digit(s[p]) for p in places if p < len(s)) for s in full]
    errors = []
    for a in range(len(texts)):
        for b in range(len(texts)):
            n, m = sorted((len(shown[a]), len(shown[b])))
            weight = [2 ** octave_of(p) / per[octave_of(p)] for p in places[:m]]
            want = sum(w for w, c, d in zip(weight, shown[a], shown[b]) if c == d) / sum(weight) if m else 1.0
            got = edit_fingerprint.likeness(marks[a], marks[b])
            assert abs(got - want) < 1e-12
            if min(len(texts[a]), len(texts[b])) > 1000 and len(full[a]) and abs(len(full[a]) - len(full[b])) < 0.1 * len(full[a]):
                agree = np.mean([digit(c) == digit(d) for c, d in zip(full[a], full[b])])
                errors.append(abs(got - agree))
    assert len(errors) > 8 and np.mean(errors) < 0.1  # the estimate is near the share of all places that agree
