"""Substring dedup: passages that several documents share stay in one and are removed from the others.

Two kinds of paragraphs are looked at:
- lines of at least LEAST_WORDS words, and blocks of lines between blank ones, by MinHash banding: colliding
  paragraphs are verified by exact Jaccard similarity of their word 5-grams and clustered by components; the
  first one of a cluster stays, and so do those of fewer than CUT_WORDS words;
- passages inside lines or across them. Every word 5-gram whose hash is the least among `window` in a row
  starts a passage of `passage` words; passages with the same words are copies. Chains of copies
  that overlap go on at both ends as far as some document with a smaller id has the same words. A run of window + passage - 1 or more words that two
  documents share, wherever it starts, holds such a passage, and goes whole. With a window of 1 every word starts a passage,
  so every shared run of `passage` words or more goes, at some eight times the passages of the default.

Nothing is told by 64 bits alone: a word is two independent hashes of its characters, passages, their contexts and equal paragraphs are keys
of 128 bits that take one half from each, and paragraphs that meet in a band of the first hash are compared by the second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_ids, map_batches, pieces, texts_of, written
from .near import jaccard_verifier, near_links
from .shingles import MULT, SHINGLE, Words, both_hashes, choose_bands, grams, mix, range_keys, read_words

#: Words (as white space separates them) of a line that is a paragraph, and of a block of shorter lines.
LEAST_WORDS, BLOCK_WORDS = SHINGLE, 36
WINNOW, PASSAGE = 16, 36
#: Words that a paragraph of a cluster needs to be cut: shorter ones, such as headlines and set phrases, are found
#: and clustered too, but stay.
CUT_WORDS = 36
#: MinHash hashes of a paragraph at most.
SIMILARITY, RECALL, HASHES = 0.8, 0.98, 32
#: Characters of the texts whose words are read at a time, and places whose contexts are.
CHARS, PLACES = 1 << 18, 1 << 13


def anchors(words: np.ndarray, sizes: np.ndarray, n: int = SHINGLE, window: int = WINNOW, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of all texts, given by their words' two hashes (rows) and numbers: which text, first word, and a 128-bit hash
    of the words as two 64-bit numbers.

    A passage starts where an n-gram's hash is the least of some `window` n-grams in a row (the last of
    equals) and ends within its text.
    """
    total = words.shape[1]
    if total < max(window, passage):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = grams(words[0], n)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    end = np.repeat(ends, sizes)
    at = np.arange(total)
    last = end - n  # the last n-gram's place of each text
    h[at > last] = np.uint64(0xFFFFFFFFFFFFFFFF)
    # the place of the least hash among h[i : i + window], by doubling
    low, place, width = h, at, 1
    while width < window:
        step = min(width, window - width)
        low2, place2 = np.r_[low[step:], np.full(step, np.uint64(0xFFFFFFFFFFFFFFFF))], np.r_[place[step:], np.full(step, total)]
        take = low2 <= low
        low, place = np.where(take, low2, low), np.where(take, place2, place)
        width += step
    inside = at + window - 1 <= last
    start = np.unique(place[inside]) if inside.any() else np.zeros(0, np.int64)
    start = start[start + passage <= end[start]] if len(start) else start
    hashes = []
    for base, half in zip((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)), words):
        key = np.zeros(len(start), np.uint64)
        for k in range(passage):
            key = (key ^ half[start + k]) * base
            key ^= key >> np.uint64(29)
        hashes.append(mix(key))
    begin = ends - sizes
    return text[start], start - begin[text[start]] if len(start) else start, hashes[0], hashes[1]


def passages(rows: DataFrame, window: int = WINNOW, passage: int = PASSAGE) -> DataFrame:
    """(id, text) to (id, h1, h2, words array<int>): each passage of a document once, with its places (see
    anchors). A text that repeats itself has few passages however long it is."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            texts = texts_of(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for a, b in pieces(texts, CHARS):
                which, word, h1, h2 = anchors(*both_hashes(texts[a:b]), window=window, passage=passage)
                order = np.lexsort((word, h2, h1, which))
                which, word, h1, h2 = which[order], word[order], h1[order], h2[order]
                fresh = np.ones(len(which), bool)
                fresh[1:] = (which[1:] != which[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                first = np.flatnonzero(fresh)
                sizes = np.diff(np.r_[first, len(which)])
                for column, x in zip(out, (ids[a:b][which[first]], h1[first].view(np.int64), h2[first].view(np.int64), word, sizes)):
                    column.append(x)
            id_, h1, h2, word, sizes = (np.concatenate(c) for c in out)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(word, pa.int32()))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (id_, h1, h2)), lists], names=["id", "h1", "h2", "words"])

        return f

    return map_batches(rows, make, "id long, h1 long, h2 long, words array<int>")


def line_places(words: Words) -> np.ndarray:
    """For each line of the texts, and the end, the number of words with a hash before it."""
    chunks = np.searchsorted(words.line, np.arange(words.lines + 1))
    return np.r_[0, np.cumsum(words.hash != 0)][chunks]


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last line of each paragraph, counted over all texts, and its number of words: a line of LEAST_WORDS words or more, or two or
    more lines between blank ones of which one is such a line, or which have BLOCK_WORDS words together."""
    size = np.bincount(words.line, minlength=words.lines)
    line = np.flatnonzero(size >= LEAST_WORDS)
    total = size[:0]
    head = np.zeros(words.lines + 1, bool)  # a block ends where a text does
    head[words.first_line] = True
    full = np.r_[False, size > 0, False]
    first = np.flatnonzero(full[1:-1] & (~full[:-2] | head[:-1]))
    last = np.flatnonzero(full[1:-1] & (~full[2:] | head[1:]))
    if len(first):
        bounds = np.stack([first, last + 1], 1).ravel()
        padded = np.r_[size, 0]
        most, total = np.maximum.reduceat(padded, bounds)[::2], np.add.reduceat(padded, bounds)[::2]
        block = (last > first) & ((most >= LEAST_WORDS) | (total >= BLOCK_WORDS))
        first, last, total = first[block], last[block], total[block]
    return np.r_[line, first], np.r_[line, last], np.r_[size[line], total]


def paragraph_grams(words: Words, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """5-gram hashes, from either hash of the words, and of each paragraph (first and last line) the range of them that are its own. One
    of fewer words has one 5-gram, of all its words; one without words has none."""
    known = hashes[words.hash != 0]
    place = line_places(words)
    start, end = place[first], place[last + 1]
    short = np.flatnonzero((end - start < SHINGLE) & (end > start))
    padded = np.zeros((len(short), SHINGLE), np.uint64)
    for row, k in zip(padded, short.tolist()):
        row[: end[k] - start[k]] = known[start[k] : end[k]]
    found = np.r_[grams(known), grams(padded.ravel())[::SHINGLE]]
    stop = np.maximum(start, end - SHINGLE + 1)
    start[short] = len(known) + np.arange(len(short))
    stop[short] = start[short] + 1
    return found, start, stop


def paragraph_signatures(rows: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(id, text) to (doc, line, upto, words, same, bands) of the paragraphs that have words. `same` holds two sums, of the
    5-grams of either hash. A paragraph that only equal sets of 5-grams can be similar to has the first band alone."""
    bands, band_rows = choose_bands(similarity, recall, HASHES)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = np.array(batch.column(0).to_pylist(), np.int64), texts_of(batch.column(1))
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            same = [b""]
            for a, b in pieces(texts, CHARS):
                words = read_words(texts[a:b], both=True)
                first, last, count = paragraphs(words)
                hashes, start, stop = paragraph_grams(words, words.hash, first, last)
                others = paragraph_grams(words, words.other, first, last)[0]
                some = stop > start
                first, last, count, start, stop = first[some], last[some], count[some], start[some], stop[some]
                if not len(first):
                    continue
                bounds = np.stack([start, stop], 1).ravel()
                sums = [np.add.reduceat(np.r_[x, np.uint64(0)], bounds)[::2] for x in (hashes, others)]
                same.append(np.stack(sums, 1).astype("<u8").tobytes())
                size = stop - start
                width = np.where(size >= similarity * (size + 1), bands, 1)
                keys = range_keys(hashes, start, stop, bands, band_rows).view(np.int64)
                text = np.searchsorted(words.first_line, first, "right") - 1
                base = words.first_line[text]
                for column, x in zip(out, (ids[a:b][text], first - base, last - base, count, width, keys[np.arange(bands) < width[:, None]])):
                    column.append(x)
            doc, line, upto, count, width, keys = (np.concatenate(c) for c in out)
            digests = pa.Array.from_buffers(pa.binary(16), len(doc), [None, pa.py_buffer(b"".join(same))]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)], pa.int32()), pa.array(keys, pa.int64()))
            columns = [pa.array(x, pa.int64()) for x in (doc, line, upto, count)]
            return pa.RecordBatch.from_arrays([*columns, digests, lists], names=["doc", "line", "upto", "words", "same", "bands"])

        return f

    return map_batches(rows.select("id", "text"), make, "doc long, line long, upto long, words long, same binary, bands array<long>")


def flat_structs(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Of a column of lists of structs: the row that each struct is in, and fields of integers; null counts as empty."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy()
    found = column.flatten()
    fields = (found.field(found.type.get_field_index(c)) for c in names)
    return np.repeat(np.arange(len(sizes)), sizes), *(f.to_numpy(zero_copy_only=False) for f in fields)


def paragraph_sets(rows: DataFrame) -> DataFrame:
    """(text, places array<struct<id, line, upto>>) to (id, payload): each place's sorted set of 5-grams, of the second hash."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(0))
            row, id_, line, upto = flat_structs(batch.column(1), "id", "line", "upto")
            ids, sets = [], []
            for a, b in pieces(texts, CHARS):
                mine = slice(*np.searchsorted(row, (a, b)))
                words = read_words(texts[a:b], both=True)
                base = words.first_line[row[mine] - a]
                here = base + upto[mine] < np.r_[words.first_line[1:], words.lines][row[mine] - a]
                hashes, start, stop = paragraph_grams(words, words.other, (base + line[mine])[here], (base + upto[mine])[here])
                ids += id_[mine][here].tolist()
                sets += [np.unique(hashes[s:e]).tobytes() for s, e in zip(start.tolist(), stop.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "payload"])

        return f

    return map_batches(rows.select("text", "places"), make, "id long, payload binary")


def paragraph_clusters(rows: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Paragraphs in a cluster of two or more: (id, line, upto, words, keep_id, keep_line), a row per paragraph."""
    # a paragraph's number is fixed once it is written; any document ids and numbers of lines take part
    items = written(paragraph_signatures(rows, similarity, recall).withColumn("id", F.monotonically_increasing_id()), "lines")
    places = items.select("id", "doc", "line", "upto", "words")

    def payload(ids: DataFrame) -> DataFrame:
        wanted = places.join(ids, "id", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("id", "line", "upto")).alias("places"))
        wanted = written(wanted.withColumnRenamed("doc", "id"), "line-places")
        return paragraph_sets(join_ids(rows, wanted.select("id"), "id", "left_semi").join(wanted, "id"))

    found = near_links(items, payload, "binary", jaccard_verifier(similarity)).where("class_size > 1")
    found = written(found.select("id", "class_id").join(places, "id"), "line-classes")
    drop_written(items)
    kept = written(found.groupBy("class_id").agg(F.min(F.struct("doc", "line")).alias("keep")), "line-kept")
    return join_ids(found, kept, "class_id", "inner").select(F.col("doc").alias("id"), "line", "upto", "words", F.col("keep.doc").alias("keep_id"), F.col("keep.line").alias("keep_line"))


def context_keys(words: np.ndarray, place: np.ndarray, room: np.ndarray, h1: np.ndarray, h2: np.ndarray, side: int, reach: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """A row per passage, given by its first word and hash: 128-bit keys (two numbers) of the passage with the 1, 2, ... `reach`
    words before it (side 0) or after it (side 1), and which of these its text has; `room` is how many words of
    the text there are on that side."""
    one, two = h1.view(np.uint64), h2.view(np.uint64)
    key = np.stack([mix(one ^ mix(two + np.uint64(side))), mix(two ^ mix(one + np.uint64(side + 2)))], 1)
    start, step = (place + passage, 1) if side else (place - 1, -1)
    keys = np.zeros((len(place), reach, 2), np.uint64)
    for k in range(reach):
        at = np.clip(start + step * k, 0, max(0, words.shape[1] - 1))
        word = words[:, at].T if words.shape[1] else np.zeros((len(place), 2), np.uint64)
        key = mix((key ^ word) * MULT + np.uint64(k))
        keys[:, k] = key
    return keys.view(np.int64), np.arange(reach) < room[:, None]


def chains(gone: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(id, h1, h2, words, keep_id) to a row per chain of passages of a document without a gap between them: (id,
    first, last: the first words of its first and last passage, head, tail: these passages' hashes, keep_ids)."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            row, h1, h2, keep = flat_structs(batch.column(1), "h1", "h2", "keep_id")
            listed = batch.column(1).flatten().field(2)
            sizes = np.diff(listed.offsets.to_numpy())
            word, of = listed.flatten().to_numpy(), np.repeat(np.arange(len(row)), sizes)
            order = np.lexsort((word, row[of]))
            word, of = word[order].astype(np.int64), of[order]
            new = np.ones(len(word), bool)
            new[1:] = (row[of[1:]] != row[of[:-1]]) | (np.diff(word) > passage)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(word)] - 1 if len(first) else first
            chain = np.cumsum(new) - 1
            kept = np.lexsort((keep[of], chain))
            chain, kept = chain[kept], keep[of][kept]
            fresh = np.ones(len(kept), bool)
            fresh[1:] = (chain[1:] != chain[:-1]) | (kept[1:] != kept[:-1])
            counts = np.bincount(chain[fresh], minlength=len(first))
            ends = [pa.StructArray.from_arrays([pa.array(h1[of[k]], pa.int64()), pa.array(h2[of[k]], pa.int64())], ["h1", "h2"]) for k in (first, last)]
            keeps = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(kept[fresh], pa.int64()))
            columns = [pa.array(x, pa.int64()) for x in (ids[row[of[first]]], word[first], word[last])]
            return pa.RecordBatch.from_arrays([*columns, *ends, keeps], names=["id", "first", "last", "head", "tail", "keep_ids"])

        return f

    listed = gone.groupBy("id").agg(F.collect_list(F.struct("h1", "h2", "words", "keep_id")).alias("listed"))
    return map_batches(listed, make, "id long, first long, last long, head struct<h1: long, h2: long>, tail struct<h1: long, h2: long>, keep_ids array<long>")


def passage_contexts(texts: DataFrame, window: int = WINNOW, passage: int = PASSAGE) -> DataFrame:
    """(id, text, listed, ends) to (id, place, side, keys): of each document the keys of the contexts of all listed
    passages (place null), and of each end of its chains the keys from the nearest context to the farthest."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, all_texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            row, h1, h2 = flat_structs(batch.column(2), "h1", "h2")
            listed = batch.column(2).flatten().field(2)
            of = np.repeat(np.arange(len(row)), np.diff(listed.offsets.to_numpy()))
            word, row, h1, h2 = listed.flatten().to_numpy().astype(np.int64), row[of], h1[of], h2[of]
            own = flat_structs(batch.column(3), "place", "side", "h1", "h2")
            out: list[list] = [[], [], [], []]
            keys: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
            for a, b in pieces(all_texts, CHARS):
                words, sizes = both_hashes(all_texts[a:b])
                begin = np.cumsum(sizes) - sizes

                def contexts(at: np.ndarray, row: np.ndarray, h1: np.ndarray, h2: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
                    room = sizes[row - a] - at - passage if side else at
                    return context_keys(words, begin[row - a] + at, room, h1, h2, side, window - 1, passage)

                lo, hi = np.searchsorted(row, (a, b)).tolist()
                found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]]
                for c in range(lo, hi, PLACES):
                    block = slice(c, min(hi, c + PLACES))
                    rows, values = [], []
                    for side in (0, 1):
                        k, has = contexts(word[block], row[block], h1[block], h2[block], side)
                        rows.append(np.repeat(row[block], has.sum(1)))
                        values.append(k[has])
                    rows, values = np.concatenate(rows), np.concatenate(values)
                    order = np.lexsort((values[:, 1], values[:, 0], rows))
                    rows, values = rows[order], values[order]
                    fresh = np.ones(len(rows), bool)
                    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1]).any(1)
                    found[0].append(rows[fresh])
                    found[1].append(values[fresh])
                rows, values = (np.concatenate(x) for x in found)  # rows ascend from block to block
                at, counts = np.unique(rows, return_counts=True)
                out[0] += [ids[k] for k in at.tolist()]
                out[1] += [None] * len(at)
                out[2] += [None] * len(at)
                out[3] += counts.tolist()
                keys.append(values)
                lo, hi = np.searchsorted(own[0], (a, b)).tolist()
                for side in (0, 1):
                    which = np.flatnonzero(own[2][lo:hi] == side) + lo
                    place = own[1][which].astype(np.int64)
                    k, has = contexts(place, own[0][which], own[3][which], own[4][which], side)
                    out[0] += [ids[r] for r in own[0][which].tolist()]
                    out[1] += place.tolist()
                    out[2] += [side] * len(which)
                    out[3] += has.sum(1).tolist()
                    keys.append(k[has])
            flat = np.concatenate(keys)
            each = pa.Array.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(flat.astype("<i8").tobytes())]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out[3]]), pa.int32()), each)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), lists], names=["id", "place", "side", "keys"])

        return f

    return map_batches(texts.select("id", "text", "listed", "ends"), make, "id long, place long, side long, keys array<binary>", rows=128)  # a text has many keys


def _range(a, b):
    """A range of words as one number."""
    return F.shiftleft(a.cast("long"), 32) + b.cast("long")


def passage_copies(rows: DataFrame, window: int = WINNOW, passage: int = PASSAGE) -> DataFrame:
    """Passages that a document with a smaller id has too: (id, range of words, keep_ids).

    At both ends of a chain of such passages, a range goes on as far as any place of the same passage in any
    document with a smaller id has the same words around it. With a window of 1 there is nothing to go on to.
    """
    if window < 1 or passage < SHINGLE:
        raise ValueError(f"a window of 1 or more and passages of {SHINGLE} words or more are needed")
    found = written(passages(rows, window, passage), "passages")
    groups = found.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.max("id").alias("most")).where("most > keep_id").select("h1", "h2", "keep_id")
    copies = written(found.join(groups, ["h1", "h2"]), "copies")
    drop_written(found)
    chained = written(chains(copies.where("id <> keep_id"), passage), "chains")
    whole = chained.select("id", _range(F.col("first"), F.col("last") + passage).alias("range"), "keep_ids")
    if window == 1:
        return whole
    end = lambda h, place, side: F.struct(f"{h}.h1", f"{h}.h2", F.col(place).alias("place"), F.lit(side).cast("long").alias("side"))
    ends = chained.select("id", F.explode(F.array(end("head", "first", 0), end("tail", "last", 1))).alias("e")).select("id", "e.*")
    # every document that holds the passage of an end, with all its places there, and the ends of its own
    sides = written(ends.select("h1", "h2").distinct(), "end-passages")
    listed = lambda t, *c: t.groupBy("id").agg(F.collect_list(F.struct("h1", "h2", *c)).alias("listed"))
    holders = listed(join_ids(copies, sides, ["h1", "h2"], "left_semi"), "words")
    around = written(holders.join(listed(ends, "place", "side").withColumnRenamed("listed", "ends"), "id", "left"), "holders")
    keyed = written(passage_contexts(join_ids(rows, around.select("id"), "id", "left_semi").join(around, "id"), window, passage), "context-keys")
    least = keyed.where("place is null").select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least")
    least = written(least.select("key", "least"), "contexts")
    asked = keyed.where("place is not null").select("id", "place", "side", F.posexplode("keys").alias("k", "key"))
    # what is shared with k words is shared with fewer, so the longest counts
    far = join_ids(asked, least, "key", "inner").where("least < id").groupBy("id", "place", "side").agg(F.max(F.struct("k", "least")).alias("m"))
    left, more = F.when(F.col("side") == 0, F.col("m.k") + 1).otherwise(0), F.when(F.col("side") == 1, F.col("m.k") + 1).otherwise(0)
    grown = far.select("id", _range(F.col("place") - left, F.col("place") + passage + more).alias("range"), F.array("m.least").alias("keep_ids"))
    return whole.unionByName(grown)


def removals(rows: DataFrame, cut_words: int, window: int = WINNOW, passage: int = PASSAGE) -> DataFrame:
    """Documents that lose text: (id, lines array<int>, words array<long>: ranges of words, keep_ids array<long>). Only
    documents that share with another document are listed; a passage repeated within one document stays."""
    cut = paragraph_clusters(rows).where((F.col("id") != F.col("keep_id")) & (F.col("words") >= cut_words))
    lines = cut.select("id", F.explode(F.sequence(F.col("line").cast("int"), F.col("upto").cast("int"))).alias("line"), F.array("keep_id").alias("keep_ids"))
    both = lines.unionByName(passage_copies(rows, window, passage), allowMissingColumns=True)
    return both.groupBy("id").agg(F.collect_set("line").alias("lines"), F.collect_list("range").alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keep_ids")))).alias("keep_ids"))


def spans_of(texts: list[str], lines: list[list[int]], words: list[list[int]]) -> list[list[tuple[int, int]]]:
    """What goes of each text, as ranges of code points, in order and apart; `words` are ranges as numbers. Places
    beyond a text are passed by: rows may share an id but not the text."""
    out: list[list[tuple[int, int]]] = []
    for a, b in pieces(texts, CHARS):
        found = read_words(texts[a:b])
        some = found.hash != 0
        start, end = found.start[some], found.end[some]
        sizes = np.bincount(found.text[some], minlength=b - a)
        begin = np.cumsum(sizes) - sizes
        ranges = np.array([x for w in words[a:b] for x in w], np.int64)
        of = np.repeat(np.arange(b - a), [len(w) for w in words[a:b]])
        lo, hi = ranges >> 32, ranges & 0xFFFFFFFF
        good = (hi <= sizes[of]) & (lo < hi)
        # ranges of all texts in one order, those of a text apart from the next one's
        lo, hi, of = lo[good] + (begin + np.arange(b - a))[of[good]], hi[good] + (begin + np.arange(b - a))[of[good]], of[good]
        order = np.argsort(lo, kind="stable")
        lo, hi, of = lo[order], hi[order], of[order]
        reach = np.maximum.accumulate(hi) if len(hi) else hi
        first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]]) if len(lo) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(lo)] - 1 if len(first) else first
        of = of[first]
        parts: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
        for k, x, y in zip(of.tolist(), start[lo[first] - of].tolist(), end[reach[last] - of - 1].tolist()):
            parts[k].append((x, y))
        for text, gone, part in zip(texts[a:b], lines[a:b], parts):
            if gone:
                at, bounds = 0, []
                for line in text.split("\n"):
                    bounds.append((at, at + len(line)))
                    at += len(line) + 1
                part = sorted(part + [bounds[k] for k in gone if k < len(bounds)])
            joined: list[tuple[int, int]] = []
            for x, y in part:
                if joined and (x <= joined[-1][1] or text[joined[-1][1] : x].isspace()):
                    joined[-1] = (joined[-1][0], max(y, joined[-1][1]))
                else:
                    joined.append((x, y))
            out.append(joined)
    return out


def _spans(texts: list[str], lines: pa.Array, words: pa.Array) -> list[list[tuple[int, int]]]:
    return spans_of(texts, lines.to_pylist(), words.to_pylist())


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without ranges, and without the white space that follows each (or goes before the last)."""
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        while b < len(text) and text[b].isspace():
            b += 1
        at = b
    kept.append(text[at:])
    out = "".join(kept)
    return out.rstrip() if gone and at >= len(text) else out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as string) as text").where("id is not null")


def substring_spans(docs: DataFrame, cut_words: int = CUT_WORDS, window: int = WINNOW, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that loses text: doc_id, n_spans, removed_chars, spans (array<struct<start, end>>,
    in code points), keep_doc_ids (documents with smaller ids that hold what it loses; each part stays in the first).

    Of each cluster of near-duplicate paragraphs, and of each repeated passage, the occurrence in the
    document with the smallest id stays; paragraphs of fewer than `cut_words` words (LEAST_WORDS cuts all) stay
    unless a repeated passage covers them. A run of window + passage - 1 words or more that a document with a smaller id
    has goes whole; one of `passage` words or more goes if a passage starts in it, which a window of 1 makes sure of. Documents without a shared passage are not listed, nor are rows
    without an id, null and empty texts. Rows that share an id are one document, cut each by its own text.
    An empty table gives an empty table. Texts are read whole, and columns of `docs` other than the two are not
    read, whatever their names.
    """
    rows = _rows(docs, id_col, text_col)
    gone = written(removals(rows, cut_words, window, passage), "removals")
    hit = join_ids(rows, gone.select("id"), "id", "left_semi").join(gone, "id")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _spans(texts_of(batch.column(1)), batch.column(2), batch.column(3))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            rows = [[{"start": a, "end": b} for a, b in s] for s in found]
            columns = [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([sum(b - a for a, b in s) for s in found], pa.int64()), pa.array(rows, kind), batch.column(4)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_spans", "removed_chars", "spans", "keep_doc_ids"])

        return f

    return map_batches(hit.select("id", "text", "lines", "words", "keep_ids"), make, "doc_id long, n_spans long, removed_chars long, spans array<struct<start: long, end: long>>, keep_doc_ids array<long>").where("n_spans > 0")


def substring_dedup(docs: DataFrame, cut_words: int = CUT_WORDS, window: int = WINNOW, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns, without the passages that stay elsewhere; where there is an
    n_chars column it is set to the new text's length. A document that loses all its text goes; rows without an id,
    null and empty texts stay as they are. Rows that share an id are one document, and each is cut by its own text; rows that
    repeat stay repeated; an empty table gives an empty table. Parameters are as in substring_spans. Other columns keep their values, whatever their names."""
    gone = written(removals(_rows(docs, id_col, text_col), cut_words, window, passage), "removals")
    names = docs.columns
    own = [f"{c}_{'_'.join(names)}" for c in ("lines", "words")]  # names that no column of docs has
    ids = gone.select(F.col("id").alias(id_col))
    places = gone.select(F.col("id").alias(id_col), F.col("lines").alias(own[0]), F.col("words").alias(own[1]))
    hit = join_ids(docs, ids, id_col, "left_semi").join(places, id_col).select(*[f"`{c}`" for c in [*names, *own]])
    at = names.index(text_col)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = batch.columns[:-2]
            texts = texts_of(columns[at])
            columns[at] = pa.array(map(without, texts, _spans(texts, batch.column(len(names)), batch.column(len(names) + 1))), pa.string())
            return pa.RecordBatch.from_arrays(columns, names=names)

        return f

    new = map_batches(hit, make, docs.schema).where(F.length(text_col) > 0)
    if "n_chars" in names:
        new = new.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return join_ids(docs, ids, id_col, "left_anti").unionByName(new.select(*[f"`{c}`" for c in names]))
