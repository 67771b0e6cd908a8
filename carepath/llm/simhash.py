"""SimHash near-duplicates: fingerprints meet at the anchors of a covering code.

The anchors are the words of a linear code over 64 bits. A fingerprint's home is its nearest anchor, at some distance
r, which is at most the code's covering radius. Of two fingerprints that differ in at most `most` bits let x have the
smaller r: the other one, y, lies within r(x) + most <= r(y) + most of x's home. So it is enough to send each
fingerprint to every anchor within r + most of it, and to compare each anchor's home fingerprints with all it got."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, map_batches, partitions, tidy, written
from .components import components

SHINGLE, SEED, BITS, MOST = 4, 42, 64, 4
#: Hashes whose bits are counted at a time, and fingerprints that are sent to anchors at a time.
HASHES, POINTS = 1 << 15, 64
#: Fingerprints of a block: a group compares two of them.
BLOCK = 8192
#: Dimensions of the code by the number of distinct fingerprints: the first one whose bound holds them. More words are
#: more copies of each fingerprint (13, 32, 134 on random ones) but fewer that meet at an anchor.
DIMENSIONS = {7: 1 << 18, 10: 1 << 22, 16: 1 << 63}


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Of a UTF-8 text: A-Z lower-cased, words at ASCII white space, XXH64 of n-word shingles; a bit is 1 if more than
    half of the shingles, repeats included, have it. Fewer than n words are one shingle, none give 0."""
    words = text.lower().split()  # bytes: only A-Z change, and only the six ASCII blanks split
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    k = min(n, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())
    count, total = np.zeros(BITS, np.int64), len(words) - k + 1
    digest, held = xxhash.xxh64_intdigest, []
    for a, b in spans:
        held.append(digest(plain[a:b], SEED))
        if len(held) == HASHES:
            count += _bits(held)
            held = []
    if held:
        count += _bits(held)
    return sum(1 << int(i) for i in np.flatnonzero(2 * count > total))


def _bits(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit, the lowest first."""
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t or b"", n) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

        return f

    return map_batches(rows, make, "doc_id long, fp long")


@cache
def anchors(dim: int) -> np.ndarray:
    """The 2^dim words of a linear code of length 64, dim from 7 to 16: at each element x of the field of 64 elements
    a constant and traces of multiples of x, x^9 and x^5. The first 7 dimensions are the first-order Reed-Muller
    code, all 16 an extended dual BCH code, whose words differ in 24 bits or more."""
    power = [1]
    for _ in range(62):
        power.append((power[-1] << 1) ^ (0b1000011 if power[-1] & 32 else 0))
    log = {v: k for k, v in enumerate(power)}

    def times(a: int, b: int) -> int:
        return power[(log[a] + log[b]) % 63] if a and b else 0

    def trace(a: int) -> int:
        total, x = 0, a
        for _ in range(6):
            total, x = total ^ x, times(x, x)
        return total

    rows: list[int] = [(1 << 64) - 1]
    for e in (1, 9, 5):
        for k in range(6):
            word = sum(trace(times(power[k], power[log[x] * e % 63])) << x for x in range(1, 64))
            rows.append(word)
    basis: list[int] = []
    reduced: list[int] = []
    for row in rows:  # the multiples of x^9 depend on each other
        left = row
        for b in reduced:
            left = min(left, left ^ b)
        if left:
            reduced.append(left)
            basis.append(row)
    words = np.zeros(1, np.uint64)
    for row in basis[:dim]:
        words = np.concatenate([words, words ^ np.uint64(row)])
    return words


def sent(points: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, anchor, at home) of all anchors that each fingerprint goes to; each has one home."""
    out = []
    for a in range(0, len(points), POINTS):
        apart = np.bitwise_count(points[a : a + POINTS, None] ^ code[None, :])
        home = apart.argmin(1)
        i, anchor = np.nonzero(apart <= apart.min(1)[:, None] + np.uint8(most))
        out.append((i + a, anchor, anchor == home[i]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out))


def _send(dim: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(fp, rep) to (anchor, home, fp, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = anchors(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                i, anchor, home = sent(part.column(0).to_numpy().view(np.uint64), code, most)
                where = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(home), part.column(0).take(where), part.column(1).take(where)], names=["anchor", "home", "fp", "rep"])
        tidy()

    return run


def _tally(dim: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, how many fingerprints each anchor gets, and how many are at home there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = anchors(dim)
        got, home = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                _, anchor, at_home = sent(batch.column(0).slice(a, 1024).to_numpy().view(np.uint64), code, most)
                got += np.bincount(anchor, minlength=len(code))
                home += np.bincount(anchor[at_home], minlength=len(code))
        some = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(got[some]), pa.array(home[some])], names=["anchor", "got", "homes"])
        tidy()

    return run


def near_edges(fps: np.ndarray, reps: np.ndarray, home: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(rep, least rep it is joined with) by the links of home fingerprints with all of a group."""
    order = np.argsort(reps, kind="stable")
    fps, reps, home = fps[order], reps[order], home[order]
    root = np.arange(len(fps))
    mine = np.flatnonzero(home)
    for a in range(0, len(mine), POINTS):
        linked = np.bitwise_count(fps[mine[a : a + POINTS], None] ^ fps[None, :]) <= most
        for row in np.flatnonzero(linked.sum(1) > 1).tolist():
            roots = np.unique(root[linked[row]])
            if len(roots) > 1:  # at most once per member
                root[np.isin(root, roots)] = roots[0]
    moved = np.flatnonzero(reps[root] != reps)
    return list(zip(reps[moved].tolist(), reps[root[moved]].tolist()))


def _compare(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (anchor, i, j, home, fp, rep) to edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if held and len(keys[0]) and [held[-1].column(k)[-1].as_py() for k in range(3)] != keys[:, 0].tolist():
                yield group(held)
                held = []
            at = 0
            for cut in cuts.tolist():
                yield group([*held, batch.slice(at, cut - at)])
                held, at = [], cut
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield group(held)
        tidy()

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        edges = near_edges(table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy(), table.column("home").to_numpy(), most)
        columns = list(zip(*edges)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, most: int = MOST, dim: int = 7, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all of the (fp, rep) rows, of distinct fp and rep, that differ in at most `most` bits.

    `distinct` must be a written table. An anchor's home fingerprints and those it got are cut into blocks of about
    `block`, and a group is one block of each, so no task gathers an anchor. An edge leads to the least rep that a
    group joins one with: no group gives all its pairs."""
    p = partitions(distinct.sparkSession)
    rows = distinct.select("fp", "rep")
    sizes = rows.mapInArrow(_tally(dim, most), "anchor int, got long, homes long").groupBy("anchor").agg(F.sum("got").alias("got"), F.sum("homes").alias("homes"))
    blocks = sizes.where("homes > 0").select("anchor", *(F.ceil(F.col(c) / block).cast("int").alias(a) for c, a in (("homes", "rows"), ("got", "columns"))))
    placed = rows.mapInArrow(_send(dim, most), "anchor int, home boolean, fp long, rep long")
    # one row per anchor, of which there are 2^dim
    placed = placed.join(F.broadcast(blocks), "anchor").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("rows")).cast("int")).withColumn("j", F.pmod(F.xxhash64("fp"), F.col("columns")).cast("int"))
    # a home fingerprint is sent to each block of others, any other one to each block of home fingerprints
    homes = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), (F.lit(True)).alias("home")))
    others = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), F.lit(False).alias("home")))
    others = F.when(F.col("home"), F.filter(others, lambda g: g["i"] != F.col("i"))).otherwise(others)
    groups = F.when(F.col("home"), F.concat(homes, others)).otherwise(others)
    dealt = placed.select("anchor", F.explode(groups).alias("g"), "fp", "rep").select("anchor", F.col("g.i").alias("i"), F.col("g.j").alias("j"), F.col("g.home").alias("home"), "fp", "rep")
    dealt = dealt.repartition(p, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.mapInArrow(_compare(most), "a long, b long")


def simhash_components(docs: DataFrame, n: int = SHINGLE, most: int = MOST, dim: int | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs` with an id: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Texts are read whole; null counts as empty, and texts without words have fingerprint 0, which links like any
    other. Fingerprints link if at most `most` bits differ; all such links are found, whatever `dim`, the code's
    dimensions (7, 10 or 16 by the number of distinct fingerprints). component_id is the smallest doc_id reachable.
    Equal fingerprints are one node, so copies cost nothing; rows that repeat an id and a text are repeated, and rows
    that share an id, with whatever texts, are linked, as the id is one node. Rows without an id are left out. An empty table gives an
    empty table. Columns of `docs` other than the two are not read, whatever their names.
    """
    found = written(fingerprints(docs.where(F.col(id_col).isNotNull()), n, id_col, text_col), "simhash")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "simhash-distinct")
    if dim is None:
        n_distinct = distinct.count()
        dim = next(d for d, most_rows in DIMENSIONS.items() if n_distinct <= most_rows)
    # rep is the least id of its fingerprint, and an id with several texts may lead several fingerprints: nodes are
    # ids, and such an id joins them
    shared = found.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    several = found.join(shared, "doc_id").join(distinct.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = fingerprint_links(distinct, most, dim, block).unionByName(several)
    parts = components(edges)
    classes = distinct.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "rows")
    classes = written(classes, "simhash-classes")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_sized(found, classes, ["fp"], "rows").select("doc_id", digits, "component_id")
