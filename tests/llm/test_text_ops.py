"""Encoders, counters, files, packing and extraction against the libraries and brute force."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from carepath.llm import bytebpe, html_extract, packing, prefix_bpe, repair, token_counts

PARTS = [
    "a", "B", "é", " ", "  ", "\n", "\t", "1", "'s", "'", "!", "<|endoftext|>", "　", "的", "🙂", "\x1c", "᠎", "​", " x", "don't", "\x85", "ß", "﻿",
    "\r\n", "ñ", "İ", "\xa0", "Σ", "é", "²", "_", "the", "tion", "aaaa", "<|startoftext|>", "ing", "ª", "µ",
]
SCHEMA = "doc_id long, text string, ids string, start string, n_tokens string"


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rng = random.Random(3)
    out = ["", "a", " ", "x" * 3000, "word " * 2000, "\n" * 500]
    out += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return out + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Unusual texts, nulls in every column, a repeated row, and extra columns with clashing names."""
    rows = [(k, t, "x", None, "y") for k, t in enumerate(texts)] + [(None, "null id", None, None, None), (9_000, None, None, "s", None), (5, texts[5], "x", None, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def byte_ids(docs):
    tok = bytebpe.library("byte_bpe_50k.json")
    return {(r.doc_id, r.text): tok.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}


def test_byte_bpe_is_the_library(texts):
    bpe = bytebpe.byte_bpe()
    assert all(bpe.encode(t) == bpe.encode_exact(t) == bpe.ids(t).tolist() for t in texts)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (40, 16), (512, 64)])
def test_overlap_counts_are_the_library_s(texts, chunk, overlap):
    bpe = bytebpe.byte_bpe()
    more = ["a" * 5000 + " b", "x " * 3000, "\n" * 3000 + "b" + " " * 3000, "ab<|endoftext|> " * 300, "<|endoftext|>" * 300]
    assert all(token_counts.count_huge(bpe, t, chunk, overlap) == len(bpe.encode_exact(t)) for t in texts + more)


def test_token_counts(docs, empty, byte_ids):
    got = token_counts.token_counts(docs, limit=100, chunk=256, overlap=32)
    want = sorted((str(i), len((t or "").encode()), len(ids), len(ids) > 100) for (i, t), ids in byte_ids.items() for _ in range(2 if i == 5 else 1))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(1, "Hello there, é 的")], "doc_id long, text string")
    assert token_counts.token_counts(df, "piece_bpe_32k.model").first().n_tokens == len(sp.encode("Hello there, é 的"))


def test_prefix_bpe_is_the_library(docs, empty):
    tok = bytebpe.library("word_bpe_49k.json")
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((str(r.doc_id), len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.encode_decode(docs).collect()]
    assert sorted(got) == sorted(want)
    assert prefix_bpe.encode_decode(empty).count() == 0
    row = prefix_bpe.encode_decode(docs.where("doc_id = 1"), digest=False).first()
    assert (row.ids, row.decoded) == ([320], "a</w>")


def test_every_prefix_has_the_library_s_last_token():
    tok, m = bytebpe.library("word_bpe_49k.json"), prefix_bpe.prefix_bpe("word_bpe_49k.json").matches
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 16)))
        assert m.encode(w[:-1] + chr(ord(w[-1]) + prefix_bpe.LAST)) == tok.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["random", "runs", "text", "tiny"])
def test_shards_round_trip(kind, texts):
    rng = np.random.default_rng(2)
    if kind == "random":
        docs = [(k, np.append(rng.integers(0, 60_000, int(rng.integers(0, 300))), 2).astype(np.uint32)) for k in range(50)]
    elif kind == "runs":
        docs = [(k, np.append(np.full(k * 7, 5), 2).astype(np.uint32)) for k in range(40)] + [(None, np.array([5, 6] * 300 + [2], np.uint32))]
    elif kind == "text":
        docs = [(k, np.append(bytebpe.byte_bpe().ids(t), np.uint32(2))) for k, t in enumerate(texts)]
    else:
        docs = [(-1, np.array([2], np.uint32))]
    s = repair.Shard(repair.write_shard(docs, rounds=6))
    assert s.doc_ids == [d for d, _ in docs]
    assert (s.decode_all() == np.concatenate([x for _, x in docs])).all()
    assert all((s.decode(k) == x).all() for k, (_, x) in enumerate(docs))
    if len(s.rules):
        assert s.lengths.tolist() == [len(repair.expand(np.array([s.first + k], np.uint32), s.rules, s.first)) for k in range(len(s.rules))]


def test_token_files_in_order(docs, empty, byte_ids):
    rows = sorted(byte_ids.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    want, at = [], 0
    for (doc, text), ids in rows:
        for _ in range(2 if doc == 5 else 1):
            raw = np.array([*ids, 2], "<u4").tobytes()
            want.append((str(doc), at, len(ids) + 1, crc32(raw)))
            at += len(ids) + 1
    got = repair.read_shards(repair.write_shards(docs, shard_ids=2000))
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted(want)
    assert repair.read_shards(repair.write_shards(empty)).count() == 0


def check_packing(rows, want, tokens, segments, loss):
    parts, seqs = {}, {}
    for r in rows:
        parts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        assert sum(r.length for r in s) <= tokens and len(s) <= segments and sum(r.n_loss for r in s) <= loss
    for (doc, text), ids in want.items():
        ids = np.array([*ids, 0], "<u4")
        times = 2 if doc == 5 else 1
        got = sorted((r.start, r.length, r.ids_crc32) for r in parts.get((doc, len(ids)), []))
        if times == 1 and doc is not None:
            assert [g[0] for g in got] == [sum(x[1] for x in got[:k]) for k in range(len(got))] and sum(g[1] for g in got) == len(ids)
        assert sum(g[1] for g in got) == times * len(ids)
        assert all(crc32(ids[a : a + n].tobytes()) == c for a, n, c in got)
    return seqs


def test_packing(docs, empty, byte_ids):
    seqs = check_packing(packing.pack_documents(docs, tokens=256, segments=32).collect(), byte_ids, 256, 32, 256)
    sizes = [sum(r.length for r in s) for s in seqs.values()]
    padding = sum(256 - n for n in sizes if n & (n - 1))
    assert padding <= 0.02 * sum(sizes)
    assert packing.pack_documents(empty).count() == 0


def test_packing_under_a_loss_limit(docs, byte_ids):
    flags = lambda text, ids: np.arange(len(ids)) % 2 == 0
    check_packing(packing.pack_documents(docs, tokens=256, segments=8, loss=100, loss_flags=flags).collect(), byte_ids, 256, 8, 100)


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<", "<"), ("<div", ""), ("<!-- x", ""), ("<script>x", ""), ("<p>&nbsp;x&#65;&amp;lt;", "xA&lt;"),
    ("<article><h1>T</h1><p>One.<br> two\n three</p><div class=ad>buy</div><div id=comments><p>Nice, post.</p></div></article>", "T\nOne. two three"),
    ("<nav><a href=/>x</a></nav><main><p>Body, text. More.</p></main><footer>f</footer>", "Body, text. More."),
    ("<article><header><h1>Title</h1><p>by me</p></header><p>Body text, here.</p><form><input value=x>Send</form></article>", "Title\nBody text, here."),
    ("<article><div class='entry-header'><h1 class=header>Title</h1><span>by me</span></div><p>Body text, here.</p></article>", "Title\nBody text, here."),
    ("<article><p>Body text, here.</p><article class=comment><p>Me too, yes.</p></article></article><section id=comments-area><article><p>Long reply, with marks, and more, yes.</p></article></section>", "Body text, here."),
    ("<body class='no-sidebar'><article><p>Kept, yes.</p></article><aside><p>no, no.</p></aside>", "Kept, yes."),
])
def test_extraction(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize(
    "inner, kept",
    [
        ("<div data-id=related><p>A paragraph, kept.</p></div>", True),
        ("<div title='class=ad'><p>A paragraph, kept.</p></div>", True),
        ("<div class=legal-analysis><p>A paragraph, kept.</p></div>", True),
        ("<h2 id=search>A paragraph, kept.</h2><p>Its text, here, too.</p>", True),
        ("<h2 id=notices-to-airmen>A paragraph, kept.</h2><p>Its text, here, too.</p>", True),
        ("<table class=form><tr><td>A paragraph, kept.</td></tr></table>", True),
        ("<ul><li><a href=x>A paragraph, kept. (2020), 3.</a></li><li><a href=x>Doe, R., and others. (2021).</a></li></ul>", True),
        ("<ul><li><a href=x>A paragraph, kept.</a></li><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul>", False),
        ("<div class=site-footer><p>A paragraph, kept.</p></div>", False),
        ("<div class='box cookie-notice'><p>A paragraph, kept.</p></div>", False),
        ("<div class=relatedArticles><p>A paragraph, kept.</p></div>", False),
        ("<div id=ad-slot-3><p>A paragraph, kept.</p></div>", False),
    ],
)
def test_one_word_of_a_name_does_not_drop_text(inner, kept):
    page = f"<article><p>The first paragraph, of the article, with text.</p>{inner}<p>The last paragraph, of the article.</p></article>"
    assert ("A paragraph, kept." in html_extract.extract(page)) == kept


def test_extraction_without_an_article():
    page = "<div class=top><a href=1>Link one</a> <a href=2>Link two</a></div><div id=c><h2>Headline here</h2>" + "<p>This is a long paragraph, with commas, and sentences. It goes on.</p>" * 3 + "<p>Be.</p></div><div class=x>Terms</div>"
    assert html_extract.extract(page).split("\n") == ["Headline here", *["This is a long paragraph, with commas, and sentences. It goes on."] * 3, "Be."]


def test_extraction_of_deep_and_broken_pages():
    assert html_extract.extract("<div>" * 5000 + "deep text, here." + "</div>" * 5000) == "deep text, here."
    assert html_extract.extract('<p class="x>a<p>b') is not None


def test_extract_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("text", F.lit("clash"))
    pages = pages.unionByName(spark.createDataFrame([(None, None, None, None)], "page_id long, url string, html string, text string"))
    rows = html_extract.extract_pages(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.n_chars > 0 for r in rows) == len(rows) - 1


def test_replacement_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    n = 300_000
    ids = rng.integers(0, 40_000, n).astype(np.uint32)
    # a phrase that stands only outside the first eighth of each 32,768 ids, and one id repeated
    phrase = np.arange(50_000, 50_008, dtype=np.uint32)
    for k in range(0, n - 32_768, 32_768):
        for at in range(k + 8192, k + 8192 + 40 * 16, 16):
            ids[at : at + 8] = phrase
    docs = [(0, ids), (1, np.full(100_000, 7, np.uint32)), (2, np.tile(rng.integers(0, 40_000, 50).astype(np.uint32), 2000))]
    s = repair.Shard(repair.write_shard(docs))
    assert [s.decode(k).tolist() for k in range(3)] == [x.tolist() for _, x in docs]
    whole = [repair.expand(np.array([s.first + k], np.uint32), s.rules, s.first).tolist() for k in range(len(s.rules))]
    assert phrase.tolist() in whole
    assert s.n_symbols - s.where[1] < 100  # what two documents of 100,000 ids each shrink to
    symbols = np.concatenate([repair._unpack(s.data, s.n_symbols, s.bits, int(a), int(b)) for a, b in [(0, s.n_symbols)]])
    ends = np.zeros(len(symbols), bool)
    ends[[*(s.where[1:] - 1), -1]] = True
    assert most_frequent(symbols, ends) < repair.LEAST


def most_frequent(symbols, ends):
    """How often the most frequent pair inside documents occurs without overlap."""
    counts, after = Counter(), {}
    for k, (a, b) in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
        if not ends[k] and after.get((a, b), 0) <= k:
            counts[a, b] += 1
            after[a, b] = k + 2
    return max(counts.values(), default=0)


@pytest.mark.parametrize("rules", [16_000, 60])
def test_no_pair_stays_frequent_on_real_ids(texts, monkeypatch, rules):
    monkeypatch.setattr(repair, "RULES", rules)  # few rules a round: pairs are left over from round to round
    parts = [np.append(bytebpe.byte_bpe().ids(t), np.uint32(2)) for t in texts] * 2
    ends = np.zeros(sum(map(len, parts)), bool)
    ends[np.cumsum([*map(len, parts)]) - 1] = True
    symbols, found, first = repair.compress(np.concatenate(parts), ends)
    assert (repair.expand(symbols, found, first) == np.concatenate(parts)).all() and len(found) > 60
    size = np.r_[np.ones(first, np.uint64), repair.lengths_of(found, first)][symbols].astype(np.int64)
    assert most_frequent(symbols, ends[np.cumsum(size) - 1]) < repair.LEAST


def test_ratios_decide_inside_marked_regions():
    prose = lambda k: f"<p>Paragraph {k} has words, commas, and sentences of some length. It goes on, as such text does, for a while.</p>"
    # sibling regions of nearly the same size are joined
    first, second = ("".join(map(prose, ks)) for ks in ((1, 2, 3), (4, 5, 6)))
    got = html_extract.extract(f"<body><main><article>{first}</article><article>{second}</article></main></body>")
    assert [x.split()[1] for x in got.split("\n")] == list("123456")
    # a path of short pieces without punctuation falls inside an article, far from prose
    tags = "".join(f"<div class=tag>tag {k}</div>" for k in range(8))
    got = html_extract.extract(f"<body><article><h1>Title of it</h1>{first}{second}{tags}</article></body>").split("\n")
    assert got[0] == "Title of it" and len(got) < 11 and "tag 7" not in got
    # text that a page leaves outside its mark stands if it is as dense, short text there does not
    got = html_extract.extract(f"<body><div>Terms</div><article>{prose(1)}</article><div class=x>Terms</div><div class=body>{first}{second}</div></body>")
    assert "Paragraph 6" in got and "Terms" not in got


PROSE = [
    "The committee met on Tuesday, and after a long debate it approved the plan; critics said it was too late.",
    "Residents, who had waited for years, welcomed the decision: a new bridge will cross the river, and traffic should ease.",
    "Work is expected to begin in spring, although funding, as the mayor admitted, is not yet secured.",
    "Engineers have surveyed the site, drilled test holes, and published their findings.",
]
SAID = "I think this is a fine idea, but they should, of course, have asked us first."


def article(inside="", after=""):
    paragraphs = "".join(f"<p>{p}</p>" for p in PROSE)
    return f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Bridge</h1>{paragraphs}{inside}</article>{after}<footer>(c) us</footer></body></html>"


@pytest.mark.parametrize("name", ["thread", "responses", "reader-voices", "opinions-below", "user-feedback", "paywall", "privacy", "donate", "author-bio", "most-read", "tags", "qzx"])
def test_totals_tell_foreign_parts_by_no_word(name):
    want = "\n".join(["Bridge", *PROSE])
    assert html_extract.extract(article(f'<div class="{name}"><p>{SAID}</p></div>')) == want
    thread = f'<div class="{name}"><h3>What you say</h3><p>{SAID}</p><p>Nonsense, in my view; nobody needs it, and it costs too much.</p></div>'
    assert html_extract.extract(article("", thread)) == want == html_extract.extract(article(thread))


def test_parts_that_belong_stay():
    lead = article().replace("<h1>Bridge</h1>", f'<h1>Bridge</h1><div class="lead"><p>{SAID}</p></div>')
    assert html_extract.extract(lead).split("\n") == ["Bridge", SAID, *PROSE]
    shown = {"<p>See, then:</p><ul><li><a href=a>First plan</a></li><li><a href=b>Second plan</a></li></ul><p>More, soon.</p>": ["See, then:", "First plan", "Second plan", "More, soon."],
             "<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds, it follows.</p>": ["Where x=2 holds, it follows."],
             '<div class="highlight"><pre>x = 1; y = 2, z.</pre></div>': ["x = 1; y = 2, z."]}
    for inside, more in shown.items():
        assert html_extract.extract(article(inside)).split("\n") == ["Bridge", *PROSE, *more]
    sections = "".join(f'<div class="part"><h2>Part {k}</h2><p>{p}</p></div>' for k, p in enumerate(PROSE))
    got = html_extract.extract(f"<article><h1>Bridge</h1>{sections}</article>").split("\n")
    assert got == ["Bridge", *[x for k, p in enumerate(PROSE) for x in (f"Part {k}", p)]]


def test_names_do_not_matter(sf_dir):
    """All class names replaced: the article is found whole, and next to nothing else."""
    rng, whole, lost, foreign = random.Random(2), 0, 0, 0
    for page in pq.read_table(sf_dir.replace("0.001", "0.01") + "/pages.parquet").column("html").to_pylist():
        elements, blocks = html_extract.read(page)
        want = [b.text for b in blocks if "/article" in elements[b.element].path]
        got = html_extract.extract(re.sub(r'class="[^"]*"', lambda m: f'class="c{rng.randrange(10**6)}"', page)).split("\n")  # noqa: B023
        whole += sum(map(len, want))
        lost += sum(len(w) for w in want if w not in got)
        foreign += sum(len(g) for g in got if g not in want)
    assert lost <= 0.05 * whole and foreign <= 0.02 * whole


def test_ratios_are_brute_force():
    rng = random.Random(4)
    blocks = [html_extract.Block(k, "".join(rng.choice("ab ,.!") for _ in range(rng.randrange(1, 60))), rng.randrange(0, 3)) for k in range(40)]
    paths = [(rng.randrange(2), rng.choice(["/a/p", "/a/div/p", "/b"])) for _ in blocks]
    text, marks, linked, total, fused = html_extract.ratios(paths, blocks)
    of = lambda path, f: [f(b) for p, b in zip(paths, blocks) if p == path]
    count = lambda b: sum(c in ",.!" for c in b.text)
    t = [sum(of(p, lambda b: len(b.text))) / len(of(p, len_of)) for p in paths]
    m = [(sum(of(p, count)) + 0.5) / len(of(p, len_of)) for p in paths]
    weight = [2.718281828459045 ** (-0.5 * d * d) for d in range(-3, 4)]
    smooth = lambda x, k: sum(w * x[min(max(k + d, 0), len(x) - 1)] for w, d in zip(weight, range(-3, 4))) / sum(weight)
    assert list(total) == [sum(of(p, lambda b: len(b.text))) for p in paths]
    assert list(text) == pytest.approx(t) and list(marks) == pytest.approx(m)
    assert list(linked) == pytest.approx([sum(of(p, lambda b: b.links)) / sum(of(p, lambda b: len(b.text))) for p in paths])
    assert list(fused) == pytest.approx([(smooth(t, k) * smooth(m, k)) ** 0.5 for k in range(len(blocks))])


def len_of(block):
    return len(block.text)
