"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bytebpe import byte_bpe
from .common import slices, texts_of, tidy

#: Examples that a task holds at once to choose from; its memory is this times the token limit.
WINDOW = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


class Packer:
    """Fills one sequence after another from a bounded window of examples.

    Each example is a vector (tokens, 1 segment, loss-bearing tokens). While a sequence has room, the
    example with the largest dot product of its vector and the room left, both as shares of the limits,
    goes in, of those that fit in every dimension; ties go to the one that came first. When none fits and
    the room is `least_cut` tokens or more, the largest example is cut to fill it. At the end the rest is
    cut into sequences whose lengths are powers of two, which need no padding.
    """

    def __init__(self, tokens: int, segments: int, loss: int, least_cut: int = 16):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.segments, self.loss, self.least_cut = tokens, segments, loss, least_cut
        self.need = np.zeros((0, 3))
        self.items: list[tuple] = []  # (document, first token, ids, loss flags or None)
        self.sequence = 0

    def add(self, items: list[tuple]) -> None:
        """Examples as (document, first token, ids, loss flags or None if all bear loss)."""
        need = np.array([(len(i[2]), 1, len(i[2]) if i[3] is None else int(i[3].sum())) for i in items], np.float64).reshape(-1, 3)
        self.items += items
        self.need = np.vstack([self.need, need])

    def _room_for(self, flags: np.ndarray | None, room: np.ndarray) -> int:
        """The most leading tokens of an example that fit into the room."""
        if flags is None:
            return int(min(room[0], room[2]))
        return int(min(room[0], np.searchsorted(np.cumsum(flags), room[2], "right")))

    def fill(self, target: int | None = None) -> list[tuple]:
        """One sequence: (document, first token, ids, flags, sequence, offset) of each piece."""
        room = self.limits.copy()
        if target is not None:
            room[0] = target
        out, offset = [], 0
        share = self.need / self.limits
        left = np.ones(len(self.items), bool)

        def put(item: tuple) -> None:
            nonlocal offset
            out.append((*item, self.sequence, offset))
            offset += len(item[2])
            room[0] -= len(item[2])
            room[1] -= 1
            room[2] -= len(item[2]) if item[3] is None else int(item[3].sum())

        while room[0] > 0 and room[1] > 0 and room[2] >= 0 and left.any():
            fits = left & (self.need <= room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, share @ (room / self.limits), -1.0)))
                put(self.items[k])
                left[k] = False
                continue
            k = int(np.argmax(np.where(left, self.need[:, 0], -1)))
            doc, start, ids, flags = self.items[k]
            n = self._room_for(flags, room)
            if n <= 0 or n < (self.least_cut if target is None else 1) or n >= len(ids):
                break
            put((doc, start, ids[:n], None if flags is None else flags[:n]))
            rest = None if flags is None else flags[n:]
            self.items[k] = (doc, start + n, ids[n:], rest)
            self.need[k] = (len(ids) - n, 1, len(ids) - n if rest is None else int(rest.sum()))
        keep = np.flatnonzero(left)
        self.items = [self.items[k] for k in keep.tolist()]
        self.need = self.need[keep]
        self.sequence += 1
        return out

    def drain(self, least: int) -> Iterator[tuple]:
        """Sequences while the window holds over `least` examples."""
        while len(self.items) > least:
            yield from self.fill()

    def finish(self) -> Iterator[tuple]:
        while self.items:
            total = int(self.need[:, 0].sum())
            if total >= self.tokens:
                yield from self.fill()
            else:
                yield from self.fill(1 << (total.bit_length() - 1))


def pack_documents(
    docs: DataFrame,
    tokens: int = 1024,
    segments: int = 128,
    loss: int | None = None,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_flags: Callable[[str, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss.

    Documents are encoded, `end_id` is appended, and stretches of `tokens` ids are cut off as sequences of
    their own where they keep the loss limit; what remains is packed by Packer. `loss_flags(text, ids)`
    marks the loss-bearing tokens of an example (default: all). No row is shuffled: each task packs the
    rows of its partition, holding at most WINDOW examples of fewer than `tokens` ids, so a hot source or
    key does no harm; a lost task gives the same pieces again. sequence_id is unique over tasks.
    A null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed each. An empty
    table gives an empty table; columns of `docs` other than the two are not read, whatever their names.
    """
    loss = tokens if loss is None else loss
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = byte_bpe(tokenizer), Packer(tokens, segments, loss)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def take(pieces) -> None:
            for (doc, n), start, ids, flags, seq, offset in pieces:
                rows.append((doc, start, len(ids), crc32(ids.tobytes()), n, base + seq, offset, len(ids) if flags is None else int(flags.sum())))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[] for _ in range(8)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        step = min(tokens, loss)
        for batch in (part for whole in batches for part in slices(whole)):
            fresh = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = np.append(bpe.ids(text), np.uint32(end_id)).astype("<u4")
                flags = None if loss_flags is None else loss_flags(text, ids)
                whole = len(ids) // step * step
                for s in range(0, whole, step):
                    part = None if flags is None else flags[s : s + step]
                    if step == tokens:
                        take([((doc, len(ids)), s, ids[s : s + step], part, packer.sequence, 0)])
                        packer.sequence += 1
                    else:
                        fresh.append(((doc, len(ids)), s, ids[s : s + step], part))
                if whole < len(ids):
                    fresh.append(((doc, len(ids)), whole, ids[whole:], None if flags is None else flags[whole:]))
                if len(fresh) >= WINDOW // 4:
                    packer.add(fresh)
                    fresh = []
                    take(packer.drain(WINDOW))
                if len(rows) >= 20_000:
                    yield out()
            packer.add(fresh)
            take(packer.drain(WINDOW))
        take(packer.finish())
        yield out()
        tidy()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)
