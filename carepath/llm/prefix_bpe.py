"""BPE encoding by dynamic programming over prefixes, and decoding, for a word-level BPE file.

For every prefix of a word, exactly one token can be the last of the prefix's encoding. Tokens that end at
a place are found by a suffix automaton (Aho-Corasick) over the vocabulary; of these, the one stands that
encodes as itself and is compatible with the last token of the prefix before it, that is, whose pair with
it would not be merged across. Back-pointers from the whole word give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bytebpe import library
from .common import map_batches, texts_of

#: Words whose encoding is kept per Python worker, and chunks (words with their punctuation).
KEPT_WORDS, KEPT_CHUNKS, KEPT_PAIRS = 600_000, 300_000, 500_000
#: A longer chunk is not kept.
KEPT_CHARS = 48
NEVER = 1 << 60
NOTHING = (b"", b"", 0)
#: Shifts the last character of a word, which carries the end-of-word mark, to symbols of its own.
LAST = 0xE000
#: Characters that composing leaves alone and that lower() maps one by one, as the library does.
PLAIN = re.compile("[!-~¡-¬®-ÿ]+").fullmatch
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

_made: dict[str, PrefixBpe] = {}


def prefix_bpe(name: str) -> PrefixBpe:
    if name not in _made:
        _made[name] = PrefixBpe(name)
    return _made[name]


def byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: itself where it is printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Matches:
    """The merge table of a BPE file, and the vocabulary's automaton."""

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.vocab.items()}
        to_id = {self._symbols(t): i for t, i in self.vocab.items()}
        self.symbols = {i: s for s, i in to_id.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        self.base = {s: i for s, i in to_id.items() if len(s) == 1}
        self.spines: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in to_id.items():  # a token that does not encode as itself is never emitted
            if self.spine(i) is not None:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def _symbols(self, token: str) -> str:
        """A token as a string with one character per initial symbol."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def spine(self, token: int):
        """The symbols that stand, one after another, at a token's left and right end while it is merged
        together, each with the rank of the merge that ends it; None if the token does not encode as itself."""
        if token in self.spines:
            return self.spines[token]
        parts = [self.base.get(s, -1) for s in self.symbols[token]]
        left, right, found = [], [], None
        while len(parts) > 1:
            ranks = [(self.rank[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.rank]
            if not ranks:
                break
            r, k = min(ranks)
            if k == 0:
                left.append((parts[0], r))
            if k == len(parts) - 2:
                right.append((parts[-1], r))
            parts[k : k + 2] = [self.rank[parts[k], parts[k + 1]][1]]
        if parts == [token]:
            found = ([*left, (token, NEVER)], [*right, (token, NEVER)])
        self.spines[token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text made of the two tokens encodes as just these. A merge across the border takes place
        if, at its rank, both its sides stand there: before a's side is merged away (of equal ranks the left
        goes first) and not after b's side is."""
        rank = self.rank
        good = not any((x, y) in rank and rank[x, y][0] < gone_x and rank[x, y][0] <= gone_y for x, gone_x in self.spine(a)[1] for y, gone_y in self.spine(b)[0])
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[a << 20 | b] = good
        return good

    def encode(self, symbols: str) -> list[int]:
        """Ids of one word, given as one character per initial symbol."""
        n = len(symbols)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        known = self.pairs.get
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                good = known(before << 20 | token)
                if good is None:
                    good = self.compatible(before, token)
                if not good:
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("a symbol is not in the vocabulary")
            out.append(last[n])
            n = back[n]
        return out[::-1]


class PrefixBpe:
    """Encodes texts as the tokenizers library does with the file: chunks between white space are normalised
    and split into words as it does (by the library itself where unusual characters occur), and words are
    encoded by Matches."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.library: Tokenizer = library(name)
        self.matches = Matches(path)
        self.letters = byte_letters()
        with open(path) as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.chunks: dict[str, tuple[bytes, bytes, int]] = {}

    def _word(self, letters: str) -> tuple[bytes, bytes]:
        ids = self.matches.encode(letters[:-1] + chr(ord(letters[-1]) + LAST) if self.matches.suffix else letters)
        return " ".join(map(str, ids)).encode(), " ".join(map(self.matches.text.__getitem__, ids)).encode()

    def _split(self, chunk: str) -> list[str]:
        """Words of a chunk in byte-level letters."""
        if PLAIN(chunk) and not any(c in chunk for c in "²³¹¼½¾"):
            return ["".join(map(self.letters.__getitem__, w.encode())) if not w.isascii() else w for w in WORDS.findall(chunk.lower())]
        text = self.library.normalizer.normalize_str(chunk)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes, int]:
        ids, shown = [], []
        for k, part in enumerate(self.cut(chunk) if self.cut else [chunk]):
            if k % 2:
                ids.append(str(self.special[part]).encode())
                shown.append(part.encode())
                continue
            for w in self._split(part) if part else ():
                got = self.words.get(w)
                if got is None:
                    got = self._word(w)
                    if len(self.words) < KEPT_WORDS and len(w) <= KEPT_CHARS:
                        self.words[w] = got
                ids.append(got[0])
                shown.append(got[1])
        joined = b" ".join(ids)
        found = joined, b" ".join(shown), joined.count(b" ") + 1 if joined else 0
        if len(self.chunks) < KEPT_CHUNKS and len(chunk) <= KEPT_CHARS:
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, bytes, int]:
        """Decimal ids joined by a space, the decoded text in UTF-8, and the number of ids. The file names
        no decoder, so decoding joins the tokens by spaces."""
        parts = text.replace("\n", " ").split(" ")
        got = list(map(self.chunks.get, parts))
        if None in got:
            got = [g or (self._chunk(p) if p else NOTHING) for g, p in zip(got, parts)]
        got = [g for g in got if g[2]]
        return b" ".join([g[0] for g in got]), b" ".join([g[1] for g in got]), sum([g[2] for g in got])


def encode_decode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", digest: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens and, as lowercase SHA-256 digests, ids_sha256 (of the decimal ids
    joined by one space) and decoded_sha256; with digest=False the ids (array<int>) and the decoded text.

    A null text counts as empty: no tokens, an empty decoded text. A null doc_id stays null; repeated rows
    stay repeated. Nothing is shuffled. A text of any length is encoded whole; an empty table gives an empty table;
    columns of `docs` other than the two are not read, whatever their names.
    """

    def make():
        bpe = prefix_bpe(tokenizer)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [bpe.encode(t) for t in texts_of(batch.column(1))]
            n = pa.array([x[2] for x in out], pa.int64())
            if digest:
                a, b = ([hashlib.sha256(x[k]).hexdigest() for x in out] for k in (0, 1))
            else:
                a, b = pa.array([[int(i) for i in x[0].split()] for x in out], pa.list_(pa.int32())), [x[1].decode() for x in out]
            return pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(a) if digest else a, pa.array(b, pa.string())], names=names)

        return f

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return map_batches(rows, make, f"doc_id long, n_tokens long, {names[2]} {'string' if digest else 'array<int>'}, {names[3]} string")
