"""Token files compressed by Re-Pair: frequent pairs of ids become nonterminals, shard by shard.

A shard file is, little-endian:
    magic "RPR1"; unsigned 64-bit: documents, rules, symbols, ids, bits of a symbol, first nonterminal
    rules: unsigned 32-bit left and right symbol of each nonterminal, then the unsigned 64-bit number of ids
    that each expands to (a rule uses only ids and earlier rules)
    documents: signed 64-bit doc_id, unsigned 8-bit 1 if it has one, unsigned 64-bit first symbol, unsigned
    64-bit ids before it in the shard
    symbols: the low 16 bits of each, then, where the largest has 17 bits, the top bits packed to bytes, and
    where it has more, the top bytes
No pair crosses the end of a document, so each one decodes from its own symbols alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import byte_bpe
from .common import BROADCAST_IDS, map_batches, partitions, texts_of, written

MAGIC = b"RPR1"
#: Ids of a shard, about; a longer document makes a longer shard.
SHARD_IDS = 2_000_000
#: Pairs replaced in a round at most, and the least count of a pair.
RULES, LEAST = 16_000, 8
SLOTS = 1 << 20
#: Symbols that are replaced or expanded at a time.
BLOCK = 1 << 17
#: Multipliers of the two tables that pairs are looked up in.
TABLES = ((np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)), (np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F)))


def _slot(left: np.ndarray, right: np.ndarray, table: int) -> np.ndarray:
    a, b = TABLES[table]
    return (left * a + right * b) >> np.uint32(12)


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules (left, right) and the first nonterminal of a shard; `ends` marks each document's last id.

    Each round counts pairs over the whole shard, gives the most frequent ones nonterminals, and replaces
    them from left to right, without overlap; rounds go on until no pair is left that occurs LEAST times (or
    for so many `rounds`). Where a round has replaced every frequent pair, only pairs with one of its
    nonterminals can be frequent in the next one, as others only get rarer: these alone are counted there.
    """
    seq, last = ids.astype(np.uint32), ends.copy()
    first = top = int(seq.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    new = 0
    while len(seq) > 1 and (rounds is None or len(rules) < rounds):
        near = None
        if new:
            fresh = np.flatnonzero(seq >= new)
            near = np.unique(np.r_[fresh[fresh > 0] - 1, fresh[fresh < len(seq) - 1]])
            near = near[~last[near]]
        rule, every = _frequent(seq, last, near)
        if not len(rule):
            break
        at, number, fits = _hits(seq, last, near, rule)
        seq[at] = np.uint32(top) + number
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        # a pair whose places all overlap with other pairs' needs no rule
        used = np.bincount(number, minlength=len(rule)) > 0
        if not used.all():
            renumbered = (top + np.cumsum(used) - 1).astype(np.uint32)
            big = np.flatnonzero(seq >= top)
            seq[big], rule = renumbered[seq[big] - np.uint32(top)], rule[used]
        rules.append(rule)
        new = top if every and fits else 0
        top += len(rule)
    return seq, np.vstack(rules) if rules else np.zeros((0, 2), np.uint32), first


def _pairs(seq: np.ndarray) -> np.ndarray:
    """Each symbol and the next one as one number: the left one in the low half."""
    return np.ndarray(len(seq) - 1, "<u8", np.ascontiguousarray(seq, "<u4").data, strides=(4,))


def _frequent(seq: np.ndarray, last: np.ndarray, near: np.ndarray | None) -> tuple[np.ndarray, bool]:
    """At most RULES pairs that occur LEAST times or more without overlap (at the places `near`, or all), the most
    frequent ones first, and whether these are all."""
    pairs = _pairs(seq)
    if near is None:
        count = ~last[:-1]
        same = np.flatnonzero((seq[:-1] == seq[1:]) & count)
        at = same
    else:
        pairs, count = pairs[near], np.ones(len(near), bool)
        same = np.flatnonzero(seq[near] == seq[near + 1])
        at = near[same]
    if len(same):  # in a run of one symbol every other place counts
        step = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], step, 0))
        count[same[(step - begin) % 2 == 1]] = False
    pairs = np.sort(pairs[count])
    # only where a pair is the same as the one LEAST - 1 places on does it occur often enough
    often = np.flatnonzero(pairs[LEAST - 1 :] == pairs[: len(pairs) - LEAST + 1]) if len(pairs) >= LEAST else np.zeros(0, np.int64)
    if not len(often):
        return np.zeros((0, 2), np.uint32), True
    found = pairs[often]
    start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    counts = np.diff(np.r_[start, len(found)])  # each less LEAST - 1
    order = np.argsort(-counts, kind="stable")[:RULES]
    chosen = found[start[order]]
    return np.stack([chosen & np.uint64(0xFFFFFFFF), chosen >> np.uint64(32)], 1).astype(np.uint32), len(start) <= RULES


def _hits(seq: np.ndarray, last: np.ndarray, near: np.ndarray | None, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the rules' pairs (at the places `near`, or anywhere), without overlap, the rule of each, and whether
    all rules had a place in the tables; a rule that has none has its turn in a later round."""
    tables, left_out = [], np.arange(len(rule))
    for k in range(len(TABLES)):
        slots = _slot(rule[left_out, 0], rule[left_out, 1], k)
        table = np.full(SLOTS, -1, np.int16)
        mine = np.unique(slots, return_index=True)[1]
        table[slots[mine]] = left_out[mine]
        tables.append(table)
        left_out = np.delete(left_out, mine)

    def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = tables[0][_slot(left, right, 0)]
        at = np.flatnonzero(number >= 0)
        number = number[at]
        x, y = left[at], right[at]
        good = (rule[number, 0] == x) & (rule[number, 1] == y)
        bad = np.flatnonzero(~good)  # another rule has the slot
        second = tables[1][_slot(x[bad], y[bad], 1)]
        fits = (second >= 0) & (rule[second, 0] == x[bad]) & (rule[second, 1] == y[bad])
        number[bad[fits]] = second[fits]
        good[bad[fits]] = True
        return at[good], number[good]

    if near is not None:
        at, number = look(seq[near], seq[near + 1])
        at = near[at]
    else:
        found = []
        for a in range(0, len(seq) - 1, BLOCK):  # blocks that fit in a cache
            b = min(len(seq) - 1, a + BLOCK)
            at, number = look(seq[a:b], seq[a + 1 : b + 1])
            inside = ~last[a:b][at]
            found.append((at[inside] + a, number[inside]))
        at, number = (np.concatenate(x) for x in zip(*found))
    # in a run of hits that overlap, every other one is replaced
    step = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], step, 0)) if len(at) else step
    even = (step - begin) % 2 == 0
    return at[even], number[even].astype(np.uint32), not len(left_out)


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses earlier rules only, so a few passes settle all."""
    size = np.ones(first + len(rules), np.uint64)
    while len(rules):
        new = size[rules[:, 0]] + size[rules[:, 1]]
        if (new == size[first:]).all():
            break
        size[first:] = new
    return size[first:]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of symbols."""
    out = symbols
    while len(rules):
        big = out >= first
        if not big.any():
            break
        where = np.flatnonzero(big)
        size = np.ones(len(out), np.int64)
        size[where] = 2
        start = np.cumsum(size) - size
        pair = rules[out[where] - np.uint32(first)]
        new = np.empty(int(start[-1] + size[-1]), np.uint32)
        new[start] = out
        new[start[where]] = pair[:, 0]
        new[start[where] + 1] = pair[:, 1]
        out = new
    return out


def _pack(symbols: np.ndarray, bits: int) -> bytes:
    """Low halves, then what is above them: 16, 17 or 24 bits a symbol, each found by its number."""
    if bits == 16:
        return symbols.astype("<u2").tobytes()
    low = symbols.astype("<u2").tobytes()
    high = (symbols >> np.uint32(16)).astype(np.uint8)
    return low + (np.packbits(high, bitorder="little").tobytes() if bits == 17 else high.tobytes())


def _unpack(raw: memoryview, n: int, bits: int, a: int, b: int) -> np.ndarray:
    out = np.frombuffer(raw, "<u2", b - a, 2 * a).astype(np.uint32)
    if bits == 17:
        lo, hi = a // 8, -(-b // 8)
        high = np.unpackbits(np.frombuffer(raw, np.uint8, hi - lo, 2 * n + lo), bitorder="little")[a - 8 * lo : b - 8 * lo]
        out |= high.astype(np.uint32) << np.uint32(16)
    elif bits == 24:
        out |= np.frombuffer(raw, np.uint8, b - a, 2 * n + a).astype(np.uint32) << np.uint32(16)
    return out


def write_shard(docs: list[tuple[int | None, np.ndarray]], rounds: int | None = None) -> bytes:
    """A shard file of (doc_id, ids of at least one id) in the given order."""
    sizes = np.array([len(x) for _, x in docs], np.int64)
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, rules, first = compress(ids, ends, rounds)
    expanded = lengths_of(rules, first)
    size = np.ones(len(symbols), np.uint64)
    big = symbols >= first
    size[big] = expanded[symbols[big] - np.uint32(first)]
    before = np.cumsum(size) - size
    starts = (np.cumsum(sizes) - sizes).astype(np.uint64)
    where = np.searchsorted(before, starts).astype("<u8")
    most = int(symbols.max(initial=0))
    bits = 16 if most < 1 << 16 else 17 if most < 1 << 17 else 24
    if most >= 1 << 24:
        raise ValueError("ids of more than 24 bits")
    known = np.array([d is not None for d, _ in docs], np.uint8)
    return b"".join(
        [
            MAGIC,
            struct.pack("<6Q", len(docs), len(rules), len(symbols), len(ids), bits, first),
            rules.astype("<u4").tobytes(),
            expanded.astype("<u8").tobytes(),
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            known.tobytes(),
            where.tobytes(),
            starts.astype("<u8").tobytes(),
            _pack(symbols, bits),
        ]
    )


class Shard:
    """Reads a shard file; any document decodes on its own."""

    def __init__(self, raw: bytes):
        raw = memoryview(raw)
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a shard file")
        self.n_docs, n_rules, self.n_symbols, self.n_ids, self.bits, self.first = struct.unpack_from("<6Q", raw, 4)
        at = 52
        self.rules = np.frombuffer(raw, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(raw, "<u8", n_rules, at)
        at += 8 * n_rules
        ids = np.frombuffer(raw, "<i8", self.n_docs, at).tolist()
        at += 8 * self.n_docs
        known = np.frombuffer(raw, np.uint8, self.n_docs, at).tolist()
        at += self.n_docs
        self.doc_ids = [d if k else None for d, k in zip(ids, known)]
        self.where = np.frombuffer(raw, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(raw, "<u8", self.n_docs, at).astype(np.int64)
        self.data = raw[at + 8 * self.n_docs :]

    def decode(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        b = int(self.where[k + 1]) if k + 1 < self.n_docs else self.n_symbols
        return expand(_unpack(self.data, self.n_symbols, self.bits, int(self.where[k]), b), self.rules, self.first)

    def decode_all(self) -> np.ndarray:
        parts = [expand(_unpack(self.data, self.n_symbols, self.bits, a, min(self.n_symbols, a + BLOCK)), self.rules, self.first) for a in range(0, self.n_symbols, BLOCK)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_shards(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids and `end_id` to shard files, in ascending doc_id order (rows without an id
    first, rows that repeat an id in the order of their texts); returns the written table (shard long,
    n_docs long, n_ids long, file binary), whose order by shard is the order of the ids.

    The rows are dealt out by ranges of doc_id and sorted there, so tasks are even whatever the source, and
    a task holds one shard. A null text is its end id alone; a text of any length is in one shard; an empty table
    gives no shard. Columns of `docs` other than the two are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base, k = byte_bpe(tokenizer), TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in ((base + k, pa.int64()), (len(held), pa.int64()), (n, pa.int64()), (write_shard(held), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "n_docs", "n_ids", "file"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = np.append(bpe.ids(text), np.uint32(end_id))
                held.append((doc, ids))
                n += len(ids)
                if n >= shard_ids:
                    yield out()
                    held, n, k = [], 0, k + 1
        if held:
            yield out()

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(run, "shard long, n_docs long, n_ids long, file binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Read shard files back, one row per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers).

    Documents come as they were written: a null id is null, a repeated id or row has a row each, an empty text its end
    id alone, a text of any length all its ids. No files give an empty table; of `shards` only shard, n_ids and file are read.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], []]
            for base, file in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(file.as_buffer())
                raw = memoryview(shard.decode_all().astype("<u4", copy=False)).cast("B")
                bounds = [*shard.starts.tolist(), shard.n_ids]
                columns[0] += shard.doc_ids
                columns[1] += [base + s for s in bounds[:-1]]
                columns[2] += [b - a for a, b in zip(bounds, bounds[1:])]
                columns[3] += [crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return f

    # one narrow row per shard of millions of ids goes through this window
    before = shards.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))
    few = shards.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = shards.join(F.broadcast(before) if few else before, "shard").select("base", "file")
    return map_batches(rows, make, "doc_id long, start long, n_tokens long, ids_crc32 long")
