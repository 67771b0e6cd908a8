"""Source audit, vector codes and SimHash components against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash

from carepath.llm import queries, simhash, source_audit, vector_codes

AUDIT = "doc_id long, text string, lang string, source string, n long, term string, p double, kind string, part int"


def brute_audit(rows, least, ranks):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = Counter(t for ts, r in zip(terms, rows) if r[1] == lang for t in set(ts))
        kept = {t for t, n in docs.items() if n >= least}
        groups = {r[2]: Counter() for r in rows if r[1] == lang}
        for ts, r in zip(terms, rows):
            if r[1] == lang:
                groups[r[2]].update(t for t in ts if t in kept)
        whole = sum(groups.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, ps = p(whole), {s: p(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in groups if o != s]
            lead = [(t, ps[s][t] - q[t]) for t in kept if groups[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", lead)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    pool = ["ab", "Ab", "É", "é", "ß", "x" * 40, "日本", "q r", "Ünder", "z"] + ["w" + chr(97 + k) for k in range(20)]
    rows = []
    for k in range(160):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice([f"s{j}" for j in range(9)] + [None, "Ω"])
        rows.append((rng.choice([" ", "-", "7", "\n", "\x00"]).join(rng.choices(pool, k=rng.randrange(0, 30))), lang, source))
    rows += [(None, "en", "s1"), ("", "en", "only"), ("a b", "alone", "s0"), (None, "empty", "s0"), (None, "empty", "s1")]
    rows += rows[:10] + [("ab " * 3000 + "wa", "en", "s2")]
    return rows


@pytest.mark.parametrize("least, block, chars, size", [(3, 256, 1 << 22, 200_000), (5, 2, 100, 40), (40, 3, 7, 7), (1, 256, 50, 10)])
def test_source_divergence(spark, least, block, chars, size):
    rows = audit_rows()
    docs = spark.createDataFrame([(k, t, g, s, 1, "x", 0.5, "k", 2) for k, (t, g, s) in enumerate(rows)], AUDIT).repartition(5)
    got = source_audit.source_divergence(docs, least_docs=least, ranks=4, block=block, chars=chars, rows=size)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, least, 4)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_vector_codes"])
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert len(got) > 0 and sorted(map(tuple, got)) == sorted(want.fetchall())


def test_source_divergence_of_an_empty_table(spark):
    assert source_audit.source_divergence(spark.createDataFrame([], AUDIT)).count() == 0


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows of (vec_id, vector, label), all vectors of one length that `parts` divides."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    cells = [[math.floor(Fraction(x) * 4096) for x in r[1]] for r in kept]
    w = len(cells[0]) // parts
    seeds = {}
    for r, c in sorted(zip(kept, cells), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1])):
        seeds.setdefault(r[0], c)
    books = [[c[p * w : p * w + w] for c in list(seeds.values())[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cells:
            code = []
            for p, book in enumerate(books):
                d = [sum((x - y) ** 2 for x, y in zip(c[p * w : p * w + w], e)) for e in book]
                code.append((d.index(min(d)), min(d)))
            out.append(code)
        return out

    for _ in range(rounds):
        codes = assign()
        for p, book in enumerate(books):
            for e in range(len(book)):
                mine = [c[p * w : p * w + w] for c, code in zip(cells, codes) if code[p][0] == e]
                if mine:
                    book[e] = [sum(v) // len(mine) for v in zip(*mine)]
    errors = [sum(d for _, d in code) for code in assign()]
    labels = defaultdict(int)
    for r, e in zip(kept, errors):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted(
        (r[0] is None, r[0] or 0, "".join(f"{c:02x}" for c, _ in code), min(e, most), min(labels[r[2]], most), digest) for r, code, e in zip(kept, assign(), errors)
    )


VECTORS = "vec_id long, embedding array<{}>, label int, row int, code string, rows int, error long"


def vector_rows(kind, n=150, dim=16):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.3, dim), 3 if i % 3 else 1).astype(kind)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(900, None, 1), (901, [None] + [0.5] * (dim - 1), 1), (902, [float("nan")] + [0.5] * (dim - 1), None), (-5, [float("inf")] * dim, 1)]
    return rows + rows[:7] + [(None, [0.25] * dim, 2)]


def codes_of(spark, rows, kind, **how):
    df = spark.createDataFrame([(*r, 1, "x", 3, 9) for r in rows], VECTORS.format(kind)).repartition(3)
    got = vector_codes.compress(df, **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes(spark, kind):
    rows = vector_rows({"float": np.float32, "double": np.float64}[kind])
    assert codes_of(spark, rows, kind) == brute_codes(rows)


def test_vector_codes_of_very_large_components(spark):
    rows = vector_rows(np.float64, 40)
    rows += [(3, [1e9, -1e9] + [0.1] * 14, 0), (200, [1e30] * 16, 1), (201, [-1e300, 1e300] * 8, 1), (202, [2.0**40 + 1] * 16, 2), (203, [1.7e308] * 16, 2), (-3, [3e20] * 4 + [0.0] * 12, None)]
    assert codes_of(spark, rows, "double") == brute_codes(rows)


def test_vector_codes_of_few_odd_and_no_vectors(spark):
    rows = [(5, [0.5] * 16, 1), (9, [-0.5] * 16, 1), (7, [0.5] * 16, None)]
    assert codes_of(spark, rows, "double") == brute_codes(rows)
    ragged = [(1, [0.1] * 11, 1), (2, [0.7] * 11, None), (3, [1.0], 1), (4, [], 1)]
    got = codes_of(spark, ragged, "double", entries=1)
    assert [r[1] for r in got] == [1, 2] and {r[2] for r in got} == {"00" * 8}
    assert vector_codes.bounds(11, 8) == [0, 2, 4, 6, 7, 8, 9, 10, 11]
    assert [r[1:4] for r in codes_of(spark, [(1, [], 1), (2, [], 2)], "double")] == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    assert codes_of(spark, [(1, None, 1)], "double") == codes_of(spark, [], "double") == []


def test_rounds_shuffle_only_changes(spark):
    """The sums that are kept up by differences are those of all parts, and a round without changes sends none."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 0.2, (300, 16)), 3)
    books = [[[int(v) for v in np.floor(x[e, p * 2 : p * 2 + 2] * 4096)] for e in range(4)] for p in range(8)]
    assign = vector_codes.Assign(books, 16)
    before, _ = assign(x)
    after = before.copy()
    assert assign.delta(x, before, after) == []
    after[5, 3] = (after[5, 3] + 1) % 4
    moved = assign.delta(x, before, after)
    part = np.floor(x[5, 6:8] * 4096).astype(int).tolist()
    assert sorted((d["entry"], d["n"], tuple(d["sums"])) for d in moved) == sorted([(int(after[5, 3]), 1, tuple(part)), (int(before[5, 3]), -1, tuple(-v for v in part))])


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(nodes, fps, most):
    label = {n: n for n in nodes}
    pairs = [(a, b) for a, x in zip(nodes, fps) for b, y in zip(nodes, fps) if bin(x ^ y).count("1") <= most]
    while True:
        new = dict(label)
        for a, b in pairs:
            new[a] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_codes_cover_and_keep_apart():
    for dim, apart in ((7, 32), (10, 28), (16, 24)):
        words = simhash.anchors(dim)
        assert len(np.unique(words)) == 1 << dim
        assert np.bitwise_count(words[words != 0]).min() == apart  # linear, so this is the least distance
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    for dim in (7, 10, 16):
        code = simhash.anchors(dim)
        sets = []
        for points in (x, y):
            i, anchor, home = simhash.sent(points, code, 4)
            assert home.sum() == len(points)
            sets.append([(set(anchor[i == k].tolist()), int(anchor[(i == k) & home][0])) for k in range(len(points))])
        # each pair meets at one of its homes
        assert all(a[1] in b[0] or b[1] in a[0] for a, b in zip(*sets))


@pytest.mark.parametrize("dim, block", [(7, 8192), (7, 5), (10, 64), (16, 8192)])
def test_fingerprint_links(spark, dim, block):
    rng = np.random.default_rng(dim)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = set(base.tolist()) | {0, (1 << 64) - 1}
    for f in base[:12].tolist():  # chains, and one large group
        for _ in range(4 if f != int(base[0]) else 120):
            for b in rng.integers(0, 64, int(rng.integers(1, 6))).tolist():
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    ids = rng.permutation(len(fps) * 3)[: len(fps)].tolist()
    rows = [(int(np.uint64(f).view(np.int64)), i) for f, i in zip(fps, ids)]
    edges = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, rep long").repartition(3), 4, dim, block).collect()
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert label == slow_components(ids, fps, 4)
    if block == 8192:
        assert len(edges) < 40 * len(fps)  # not all pairs of the large group


def test_simhash_components(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    rows = [(10, None), (4, ""), (11, " \t\n"), (12, "One"), (13, "one"), (14, "a b c"), (15, "a  B\x0bc"), (16, "a b c d"), (17, "É é")]
    for k in range(30):
        words = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 60, 400]))
        rows.append((100 + k, " ".join(words)))
        for j in range(3):
            changed = words[:]
            changed[rng.randrange(len(words))] = "zz"
            rows.append((200 + 3 * k + j, "  ".join(changed).upper()))
    rows += [(500, " ".join(rng.choices(vocabulary, k=120_000)))]
    rows += rows[:5] + [(601, "left apart"), (601, "quite another text here"), (602, "quite another text here"), (None, "one")]
    df = spark.createDataFrame([(i, t, "f", "c", 1, 2, 3.0) for i, t in rows], "doc_id long, text string, fp string, rep string, rows int, component_id int, a double").repartition(4)
    got = simhash.simhash_components(df)
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    kept = [(i, slow_fingerprint(t)) for i, t in rows if i is not None]
    label = slow_components([i for i, _ in kept], [f for _, f in kept], 4)
    assert sorted(map(tuple, got.collect())) == sorted((i, f"{f:016x}", label[i]) for i, f in kept)
    assert label[602] == 601


def test_simhash_of_an_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
