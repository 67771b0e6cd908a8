"""Document fingerprints: a randomised embedding that turns edit distance into Hamming distance, sampled.

All texts share random walks over their characters: at step j the walk stands on a character, writes it to
place j of the embedded string, and goes on to the next one or stays, by a random bit that depends on the
step and the character only. Texts that differ by few edits fall into step again, so their embedded strings
agree in most places. The fingerprint keeps the characters (as 4 bits) at random places that are the same
for all texts, so many in each octave of places, which makes texts of any lengths comparable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_ids, map_batches, partitions, texts_of, written
from .near import near_links
from .shingles import MULT, mix

#: Steps after which the random bits repeat, classes of characters, places sampled per octave, octaves.
PERIOD, CLASSES, SAMPLES, OCTAVES, SEED = 2048, 256, 24, 34, 11
#: Cells of the walks' table that are held at once, and the number of texts below which a plain loop is faster.
CELLS, FEW = 6_000_000, 24


def _steps() -> np.ndarray:
    """How many places a character takes from a step on: up to and with the next step whose bit says go on."""
    go = np.random.default_rng(SEED).integers(0, 2, (CLASSES, 2 * PERIOD), np.int8)
    go[:, PERIOD:] = go[:, :PERIOD]
    go[:, [PERIOD - 1, 2 * PERIOD - 1]] = 1  # every period has an end
    gap = np.zeros((CLASSES, PERIOD), np.int32)
    run = np.zeros(CLASSES, np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        run = np.where(go[:, j] == 1, 1, run + 1)
        if j < PERIOD:
            gap[:, j] = run
    return gap


def _places() -> tuple[np.ndarray, np.ndarray]:
    """Sampled places in ascending order, and the octave of each: place p is in octave floor(log2(p + 1))."""
    rng = np.random.default_rng(SEED + 1)
    places, octave = [], []
    for o in range(OCTAVES):
        size = 1 << o
        chosen = np.arange(size) if size <= SAMPLES else np.sort(rng.integers(0, size, SAMPLES))
        places.append(chosen + size - 1)
        octave.append(np.full(len(chosen), o))
    return np.concatenate(places), np.concatenate(octave)


STEPS = _steps()
FLAT = STEPS.ravel()
ROWS = [row.tolist() for row in STEPS]
PLACES, OCTAVE = _places()
#: The part of the embedded string that one sampled place stands for.
WEIGHT = (2.0 ** np.arange(OCTAVES) / np.bincount(OCTAVE))[OCTAVE]
NIBBLE = np.random.default_rng(SEED + 2).permutation(np.arange(CLASSES) % 15 + 1).astype(np.uint8)


def classes(text: str) -> np.ndarray:
    """Characters as classes: code points below 256 as they are, others by a hash."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, points, (points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def walk(texts: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """For each text, the place at which each character starts, and the place after the last; the walk of
    text k starts at place begin[k]. Texts go through the same character together."""
    out: list[np.ndarray | None] = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    a = 0
    while a < len(order):
        length = len(texts[order[min(a + FEW, len(order) - 1)]])
        b = min(len(order), a + max(FEW, CELLS // max(1, length)))
        group = order[a:b]
        sizes = [len(texts[k]) for k in group]
        together = sizes[FEW] if len(group) > FEW else 0
        at = np.array([begin[k] for k in group], np.int64)
        base = at & ~np.int64(PERIOD - 1)
        low = (at - base).astype(np.int32)
        table = np.zeros((len(group), together + 1), np.int32)
        if together:
            x = np.zeros((len(group), together), np.int32)
            for row, k in enumerate(group):
                m = min(together, len(texts[k]))
                x[row, :m] = texts[k][:m]
            x *= PERIOD
            x = np.ascontiguousarray(x.T)
            path = np.zeros((together + 1, len(group)), np.int32)
            path[0] = low
            live = len(group)
            cell, gap = np.empty(live, np.int32), np.empty(live, np.int32)
            for i in range(together):
                while sizes[live - 1] <= i:
                    live -= 1
                now = path[i, :live]
                np.bitwise_and(now, PERIOD - 1, out=cell[:live])
                np.add(cell[:live], x[i, :live], out=cell[:live])
                np.take(FLAT, cell[:live], out=gap[:live], mode="clip")
                np.add(now, gap[:live], out=path[i + 1, :live])
            table = np.ascontiguousarray(path.T)
        else:
            table[:, 0] = low
        for row, k in enumerate(group):
            n = len(texts[k])
            if n <= together:
                out[k] = table[row, : n + 1] + base[row]
            else:
                place, rest = int(table[row, together]), []
                for c in texts[k][together:].tolist():
                    place += ROWS[c][place & (PERIOD - 1)]
                    rest.append(place)
                out[k] = np.concatenate([table[row], np.array(rest, np.int64)]) + base[row]
        a = b
    return out


def sample(text: np.ndarray, path: np.ndarray, lo: int = 0) -> np.ndarray:
    """What stands at the sampled places from `lo` to the text's end, as numbers from 1 to 15."""
    a, b = np.searchsorted(PLACES, (lo, path[-1]))
    return NIBBLE[text[np.searchsorted(path, PLACES[a:b], "right") - 1]] if b > a else np.zeros(0, np.uint8)


DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def shown(marks: np.ndarray) -> str:
    return DIGITS[marks].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of places at which two embedded strings agree, of those that the longer one has."""
    n, m = min(len(a), len(b)), max(len(a), len(b))
    return float((WEIGHT[:n] * (a[:n] == b[:n])).sum() / WEIGHT[:m].sum()) if m else 1.0


def marks_of(fingerprint: str) -> np.ndarray:
    return np.array([int(c, 16) for c in fingerprint], np.uint8)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    x = [classes(t) for t in texts]
    return [sample(t, p) for t, p in zip(x, walk(x, np.zeros(len(x), np.int64)))]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, extra, doc_id, text), one part to a partition, in ascending doc_id order within and over the
    parts; the first rows of each part come again as the last ones, extra, of the part before (of the last
    part for the first). The parts' bounds are quantiles of doc_id; only one number per part is collected."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    found = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 10_000).alias("q")).first().q or []
    bounds = sorted(set(found))
    step = max(1, int(len(bounds) ** 0.5))
    fine, coarse = F.lit(bounds).cast("array<long>"), F.lit(bounds[::step]).cast("array<long>")
    passed = F.size(F.filter(coarse, lambda b: b <= F.col("key")))
    part = F.when(passed == 0, 0).otherwise((passed - 1) * step + F.size(F.filter(F.slice(fine, (passed - 1) * step + 1, step), lambda b: b <= F.col("key"))))
    rows = rows.withColumn("part", part.cast("int"))
    first = sorted((r.part, r.least) for r in rows.groupBy("part").agg(F.min("key").alias("least")).collect())
    least, before = {p: k for p, k in first}, {p: first[i - 1][0] for i, (p, _) in enumerate(first)}
    size = len(bounds) + 1
    starts = F.lit([least.get(p, 0) for p in range(size)]).cast("array<long>")
    backs = F.lit([before.get(p, 0) for p in range(size)]).cast("array<int>")
    place = lambda p, e: F.struct(p.cast("int").alias("part"), F.lit(e).alias("extra"))
    own, again = place(F.col("part"), False), place(F.get(backs, F.col("part")), True)
    to = F.when(F.col("key") == F.get(starts, F.col("part")), F.array(own, again)).otherwise(F.array(own))
    sent = rows.select(F.explode(to).alias("to"), "key", "doc_id", "text").select("to.part", "to.extra", "key", "doc_id", "text")
    return sent.repartitionById(size, "part").sortWithinPartitions("part", "extra", "key", "text").drop("key")


def _rows_of(chunk: list[tuple[int | None, str]], following: str) -> list[tuple]:
    texts = [t for _, t in chunk]
    after = [*texts[1:], following]
    x = [classes(t) for t in [*texts, following]]
    paths = walk(x, np.zeros(len(x), np.int64))
    marks = [sample(t, p) for t, p in zip(x, paths)]
    halves = [len(t) // 2 for t in texts]
    heads = [len(t) - h for t, h in zip(texts, halves)]
    tails = [x[k + 1][:h] for k, h in enumerate(halves)]
    begin = np.array([paths[k][h] for k, h in enumerate(heads)], np.int64)
    out = []
    for k, path in enumerate(walk(tails, begin)):
        head = int(np.searchsorted(PLACES, begin[k]))
        other = np.concatenate([marks[k][:head], sample(tails[k], path, int(begin[k])) if len(tails[k]) else np.zeros(0, np.uint8)])
        sha = hashlib.sha256(edited(texts[k], after[k]).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((chunk[k][0], len(texts[k]), sha, shown(marks[k]), shown(other), likeness(marks[k], other), likeness(marks[k], marks[k + 1])))
    return out


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones, or
    all, of the next document in ascending doc_id order; after the last comes the first. Rows without an id
    come first; rows that share an id follow the order of their texts. A null text counts as empty: its
    fingerprint is empty, and two empty texts are alike by 1. One row alone is its own next. A text of any length
    is walked whole; an empty table gives an empty table; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        closing: str | None = None

        def out(following: str) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = list(zip(*_rows_of(held, following)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        chars = 0
        for batch in batches:
            for extra, doc, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(3))):
                if extra:
                    closing = text if closing is None else closing
                    continue
                if held and (chars > 8_000_000 or len(held) >= 4096):
                    yield out(text)
                    chars = 0
                held.append((doc, text))
                chars += len(text)
        if held:
            yield out(held[0][1] if closing is None else closing)

    return _in_order(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def edit_similarity(a: str, b: str, least: float) -> bool:
    """Whether 1 - edit distance / longer length is at least `least`.

    What both texts begin and end with is set aside. Of the rest, a column of the distance's table is kept as the
    bits of two long integers, where it goes up and where down by one, so a column costs a few operations on integers
    of a bit per character; it ends when the columns that are left cannot make up for the distance."""
    if len(a) < len(b):
        a, b = b, a
    most = int((1 - least) * len(a) + 1e-9)
    if len(a) - len(b) > most:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    differ = np.flatnonzero(x[: len(y)] != y)
    head = int(differ[0]) if len(differ) else len(y)
    x, y = x[head:], y[head:]
    differ = np.flatnonzero(x[len(x) - len(y) :][::-1] != y[::-1])
    tail = int(differ[0]) if len(differ) else len(y)
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(y):
        return len(x) <= most
    chars, seen = np.unique(y, return_inverse=True)
    order = np.argsort(seen, kind="stable")
    where = {}
    for c, places in zip(chars.tolist(), np.split(order, np.flatnonzero(np.diff(seen[order])) + 1)):
        bits = np.zeros(len(y), np.uint8)
        bits[places] = 1
        where[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    whole, top = (1 << len(y)) - 1, len(y) - 1
    up, down, distance = whole, 0, len(y)
    for left, c in zip(range(len(x) - 1, -1, -1), x.tolist()):
        equal = where.get(c, 0)
        level = (((equal & up) + up) ^ up) | equal | down
        right_up, right_down = down | (whole & ~(level | up)), up & level
        distance += (right_up >> top & 1) - (right_down >> top & 1)
        if distance - left > most:
            return False
        right_up = (right_up << 1 | 1) & whole
        up, down = (right_down << 1 & whole) | (whole & ~(equal | down | right_up)), right_up & (equal | down)
    return distance <= most


#: Places of the walk from each character that a band samples from, and the characters it starts from at a time.
WINDOW, STARTS = 24, 1 << 18


def near_keys(text: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """A key per band of a text's classes: the least hash of `bits` sampled places, the same ones for all texts,
    of the first WINDOW places of a walk that starts anew at each character. Texts agree in a band with a
    probability of the share of walks that agree in its places, whatever the texts' lengths."""
    rng = np.random.default_rng(SEED + 3)
    picks = [rng.choice(WINDOW, bits, replace=False) for _ in range(bands)]
    out = np.full(bands, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(text), STARTS):
        x = np.r_[text[a : a + STARTS + WINDOW].astype(np.uint64) + np.uint64(1), np.uint64(0)]
        end = len(x) - 1
        at = np.arange(min(STARTS, len(text) - a))
        places = []
        for j in range(WINDOW):
            now = x[at]
            places.append(now)
            # past the end of the text the walk stays
            at = np.minimum(at + (STEPS[now.astype(np.int64) - 1, j] == 1), end)
        for k, pick in enumerate(picks):
            key = np.full(len(at), k + 1, np.uint64)
            for j in pick:
                key = mix(key * MULT + places[j])
            out[k] = min(out[k], key.min())
    return out.view(np.int64)


def edit_near(docs: DataFrame, similarity: float = 0.8, bands: int = 64, bits: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of nearly the same text: (doc_id, class_id, class_size, copies, n_links), as near_links gives them.

    Each band samples `bits` places of the walks that start at each character, and takes the least of their
    hashes (see near_keys); documents that agree in a band are verified by their edit distance. Rows without an
    id are left out; null and empty texts are linked to nothing. Equal texts are copies and verified once, rows that repeat are
    repeated, an empty table gives an empty table, texts are read whole, and columns of `docs` other than the two are not
    read, whatever their names.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as string) as text").where("id is not null")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            same = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            keys = [near_keys(classes(t), bands, bits).tolist() if t else [] for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "same", "bands"])

        return f

    def verify(payloads: list[str], ask: np.ndarray) -> np.ndarray:
        out = np.zeros(ask.shape, bool)
        for a, b in zip(*np.nonzero(ask)):
            out[a, b] = edit_similarity(payloads[a], payloads[b], similarity)
        return out

    items = written(map_batches(rows, make, "id long, same binary, bands array<long>"), "edit-bands")
    payload = lambda ids: join_ids(rows, ids, "id", "left_semi").withColumnRenamed("text", "payload")
    return near_links(items, payload, "string", verify).withColumnRenamed("id", "doc_id")
