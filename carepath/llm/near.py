"""Links between near-duplicate texts: band keys are shuffled, colliding texts verified in bounded blocks.

The n-gram join, the paragraph dedup and the edit fingerprints share this: each gives band keys and a
verifier. Steps:

1. Items whose `same` key is equal are copies: one representative each goes on.
2. Band keys held by two or more representatives make buckets. Buckets with the same members (told by
   count, least id and a sum of hashes) are one bucket.
3. A bucket is cut into blocks of at most BLOCK members; each pair of blocks is one group of at most
   2 * BLOCK members, so no task gathers a bucket, and no pair is a row.
4. Each pair is verified once, in the smallest bucket id that both share. A group gives one row per member:
   how many links it found, and an edge to the least member it is connected with in the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_sized, partitions, slices, tidy, written
from .components import components

#: Members of a block, and bytes of the payloads that are compared at a time.
BLOCK, BYTES = 512, 16 << 20

#: Gives the links among a group's members: a symmetric boolean matrix, from the payloads and the pairs asked for.
Verify = Callable[[list, np.ndarray], np.ndarray]


def near_links(items: DataFrame, payload: Callable[[DataFrame], DataFrame], payload_type: str, verify: Verify) -> DataFrame:
    """Items (id long, same binary, bands array<long>) to (id, class_id, class_size, copies, n_links).

    `items` must be a written table. `payload(ids)` gives (id, payload) for a table of ids. class_id is the
    smallest id of the item's component over the verified links and copies, class_size its items, copies
    the items with the same key, itself included, and n_links the other items linked to it, copies of itself
    included. Items without bands are linked to nothing, not even to each other. Rows may repeat; rows that
    share an id but not the key are one node, verified by one of its payloads.
    """
    full = items.where(F.size("bands") > 0)
    reps = written(full.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "reps")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    buckets = (
        keys.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("sum"))
        .where("n > 1")
        .select("key", "n", F.xxhash64("n", "least", "sum").alias("bucket"))
    )
    members = keys.join(buckets, "key").select("rep", F.struct("bucket", "n").alias("b"))
    sought = written(members.groupBy("rep").agg(F.array_sort(F.collect_set("b")).alias("buckets")), "sought")
    links = written(_verified(reps, sought, payload, payload_type, verify), "links")
    drop_written(sought)
    parts = components(links.where("n_links > 0 and root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    known = reps.select("same", "rep", "copies").join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
    known = written(known.select("same", F.coalesce("component", "rep").alias("class_id"), "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    sizes = written(known.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members")).coalesce(partitions(items.sparkSession)), "class-sizes")
    known = written(join_sized(known, sizes, ["class_id"], "members").drop("members"), "classes")
    alone = items.where(F.size("bands") == 0).select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return join_sized(full.select("id", "same"), known, ["same"], "copies").select("id", "class_id", "class_size", "copies", "n_links").unionByName(alone)


def _verified(reps: DataFrame, sought: DataFrame, payload, payload_type: str, verify: Verify) -> DataFrame:
    """(rep, root, n_links) of each group and member with a link."""
    spark = reps.sparkSession
    # one payload per id, though rows may repeat
    payloads = payload(sought.select(F.col("rep").alias("id"))).groupBy(F.col("id").alias("rep")).agg(F.min("payload").alias("payload"))
    rows = sought.join(payloads, "rep").join(reps.select("rep", "copies"), "rep")
    blocks = F.ceil(F.col("b.n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep", "b.bucket"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("mine")).alias("i"), F.greatest(other, F.col("mine")).alias("j")))
    placed = (
        rows.withColumn("ids", F.col("buckets.bucket"))
        .select("rep", "copies", "payload", "ids", F.explode("buckets").alias("b"))
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .select("rep", "copies", "payload", "ids", F.col("b.bucket").alias("bucket"), "mine", F.explode(pairs).alias("pair"))
        .select("bucket", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "rep", "mine", "copies", "ids", "payload")
    )
    dealt = placed.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (bucket, i, j), group in _groups(batches):
            out += _block(bucket, i, j, group, verify)
            if len(out) > 20_000:
                yield _links(out)
                out = []
        yield _links(out)
        tidy()

    return dealt.mapInArrow(run, "rep long, root long, n_links long")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "root", "n_links"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first three columns, over batch borders."""
    key, held = None, []
    for batch in batches:
        for part in slices(batch, 256):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[:3] != key:
                    if len(held) > 1:
                        yield key, held
                    key, held = row[:3], []
                held.append(row[3:])
    if len(held) > 1:
        yield key, held


def _block(bucket: int, i: int, j: int, group: list[tuple], verify: Verify) -> list[tuple]:
    """Links among a group's members that this bucket and pair of blocks has to verify."""
    reps, mine, copies, ids, payloads = zip(*group)
    if i < j and min(mine) == max(mine):
        return []
    n = len(reps)
    ask = np.triu(np.ones((n, n), bool), 1)
    if i < j:
        side = np.array(mine)
        ask &= side[:, None] != side[None, :]
    # the least common bucket of a pair owns it: a smaller one that both are in asks for it there
    smaller: dict[int, list[int]] = {}
    for k, x in enumerate(ids):
        for b in x:
            if b >= bucket:
                break
            smaller.setdefault(b, []).append(k)
    for ks in smaller.values():
        if len(ks) > 1:
            ask[np.ix_(ks, ks)] = False
    if not ask.any():
        return []
    linked = verify(list(payloads), ask) & ask
    if not linked.any():
        return []
    linked |= linked.T
    weight = np.array(copies, np.int64)
    counts = linked @ weight
    root = _least_reached(linked)
    return [(reps[k], reps[root[k]], int(counts[k])) for k in np.flatnonzero(counts).tolist()]


def _least_reached(linked: np.ndarray) -> np.ndarray:
    """The least member that each one is connected with, by a symmetric matrix of links."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], np.int32(len(linked))).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def jaccard_verifier(similarity: float) -> Verify:
    """Exact Jaccard similarity of sorted sets of 64-bit hashes, given as bytes. Sets of many bytes are compared part
    by part, two parts at a time."""

    def verify(payloads: list[bytes], ask: np.ndarray) -> np.ndarray:
        size = np.cumsum([len(p) for p in payloads])
        if size[-1] <= BYTES or len(payloads) <= 6:
            return compare(payloads, ask)
        part = size // max(1, BYTES // 2)
        parts = [np.flatnonzero(part == k) for k in np.unique(part)]
        out = np.zeros(ask.shape, bool)
        for k, a in enumerate(parts):
            for b in parts[k:]:
                both = a if a is b else np.r_[a, b]
                asked = ask[np.ix_(both, both)].copy()
                if a is not b:  # pairs of one part are compared by themselves
                    asked[: len(a), : len(a)] = asked[len(a) :, len(a) :] = False
                if asked.any():
                    out[np.ix_(both, both)] |= compare([payloads[x] for x in both.tolist()], asked)
        return out

    def compare(payloads: list[bytes], ask: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        sizes = np.array([len(s) for s in sets], np.int64)
        out = np.zeros(ask.shape, bool)
        # a pair whose sizes differ too much cannot be similar enough
        ask = ask & (np.minimum.outer(sizes, sizes) >= similarity * np.maximum.outer(sizes, sizes))
        if len(sets) <= 6:
            for a, b in zip(*np.nonzero(ask)):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                out[a, b] = both >= similarity * (sizes[a] + sizes[b] - both)
            return out
        if not ask.any():
            return out
        flat = np.concatenate(sets)
        values, index = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(index, kind="stable")
        index, owner = index[order], owner[order]
        # a value of one set alone is common to no pair
        shared = np.bincount(index, minlength=len(values))[index] > 1
        values, index = np.unique(index[shared], return_inverse=True)
        owner = owner[shared]
        common = np.zeros(ask.shape, np.float32)
        step = max(1, (8 << 20) // max(1, 4 * len(sets)))
        for a in range(0, len(values), step):
            lo, hi = np.searchsorted(index, (a, a + step))
            seen = np.zeros((len(sets), min(step, len(values) - a)), np.float32)
            seen[owner[lo:hi], index[lo:hi] - a] = 1
            common += seen @ seen.T
        return ask & (common >= similarity * (sizes[:, None] + sizes[None, :] - common))

    return verify

