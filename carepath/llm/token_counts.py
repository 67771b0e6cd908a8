"""Token counts. Huge documents are encoded in overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import ByteBpe, byte_bpe
from .common import map_batches, texts_of

#: A text of more characters is huge: it is encoded in chunks of about this length.
CHUNK = 32_768
#: Characters by which a chunk overlaps the one before it; doubled whenever alignment fails.
OVERLAP = 512


def _scan(bpe: ByteBpe, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The library's encoding of text[start:end]: the places in the text where a word of its splitting
    pattern starts, the number of tokens before each of them, and the number of all tokens."""
    e = bpe.exact.encode(text[start:end], add_special_tokens=False)
    if not e.ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (word[1:] < 0)])
    return np.array([a for a, _ in e.offsets], np.int64)[first] + start, first, len(e.ids)


def count_huge(bpe: ByteBpe, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlap resynchronisation, as many as of the text encoded at once.

    The splitting pattern scans from left to right and remembers nothing but its place, and merges stay
    within words. So once two scans, the left chunk's and the right chunk's, start a word at the same
    place, they agree from there on. The left scan is right but for its last word and for a special token's
    string that its end may cut. A common word start before those is therefore a proven stable boundary:
    the left chunk's tokens before it and the right chunk's from it on are spliced. Where the overlap holds
    none, it is doubled; once it would reach back to the last boundary, the left chunk is read anew from
    there, twice as long.
    """
    edge = max(map(len, bpe.special), default=0) + 2
    n, total, cut, skip = len(text), 0, 0, 0
    end = min(n, chunk)
    starts, before, size = _scan(bpe, text, 0, end)
    while end < n:
        lap = overlap
        while True:
            at = end - lap
            if at <= cut:
                end = min(n, cut + 2 * (end - cut))
                starts, before, size = _scan(bpe, text, cut, end)
                skip = 0
                break
            stop = min(n, at + max(chunk, 2 * lap))
            r_starts, r_before, r_size = _scan(bpe, text, at, stop)
            mine = starts[:-1]
            common = np.intersect1d(mine[(mine >= at) & (mine <= end - edge)], r_starts)
            if len(common):
                cut = int(common[len(common) // 2])
                total += int(before[np.searchsorted(starts, cut)]) - skip
                skip = int(r_before[np.searchsorted(r_starts, cut)])
                end, starts, before, size = stop, r_starts, r_before, r_size
                break
            lap *= 2
    return total + size - skip


class Counter:
    """Counts by the library of a tokenizer file: tokenizers for .json, sentencepiece for .model, whose
    texts are always encoded whole."""

    def __init__(self, name: str):
        self.piece = self.bpe = None
        if name.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        else:
            self.bpe = byte_bpe(name)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if self.piece is not None:
            return len(self.piece.encode(text))
        if len(text) > chunk:
            return count_huge(self.bpe, text, chunk, overlap)
        return len(self.bpe.ids(text))


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows stay repeated.
    Nothing is shuffled, and a task holds one Arrow batch and one chunk's encoding. An empty table gives an empty
    table; columns of `docs` other than the two are not read, whatever their names.
    """

    def make():
        counter = Counter(tokenizer)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            n = [counter.count(t, chunk, overlap) for t in texts]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return f

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
