"""Word shingles and MinHash signatures, computed over many texts at once."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import xxhash

SHINGLE = 5
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bases of the words' two polynomial hashes.
BASES = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Characters that are hashed at a time, and of the longest word that a polynomial hashes: there are long words that
#: differ and are equal under every polynomial modulo 2^64.
SPAN, LONGEST = 1 << 15, 1 << 10


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Of each code point: 2 white space, 1 letter or digit, 0 other; and 64 mixed bits of its lower case. Of each base,
    its powers, and those of its inverse."""
    every = [chr(k) for k in range(sys.maxunicode + 1)]
    kind = np.fromiter((2 if c.isspace() else c.isalnum() for c in every), np.uint8, len(every))
    # one character for one: a final sigma is a sigma, and the dotted capital I is a letter of its own
    lower = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every), np.uint64, len(every))
    lower[ord("\u03c2")] = ord("\u03c3")
    powers = [[np.cumprod(np.r_[np.uint64(1), np.full(SPAN, x, np.uint64)]) for x in (b, pow(b, -1, 1 << 64))] for b in BASES]
    return kind, mix((lower + np.uint64(1)) * MULT), powers


@dataclass
class Words:
    """What white space separates, of many texts, one after another."""

    text: np.ndarray  # which text
    line: np.ndarray  # which line, counted over all texts; each text's first line is a new one
    start: np.ndarray  # bounds in code points, counted from the text's start
    end: np.ndarray
    #: 64-bit hash of the word in lower case without the characters at its ends that are neither letters nor
    #: digits; 0 if none are left.
    hash: np.ndarray
    first_line: np.ndarray  # of each text
    lines: int
    #: A second hash, independent of the first, of the same characters; empty if not asked for.
    other: np.ndarray


def _bounds(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.ones(len(kind) + 2, bool)
    np.equal(kind, 2, out=blank[1:-1])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def read_words(texts: list[str], both: bool = False) -> Words:
    """The words of all texts, with one 64-bit hash each, or both."""
    kinds, bits, powers = _tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    start, end = _bounds(kind)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(lengths + 1) - lengths - 1
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, np.r_[at, len(points) + 1])))
    breaks = np.flatnonzero(points == 10)
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.r_[0, np.searchsorted(start, breaks), len(start)]))
    words = Words(text, line, start - at[text], end - at[text], np.zeros(len(start), np.uint64), np.searchsorted(breaks, at), len(breaks) + 1, np.zeros(len(start) if both else 0, np.uint64))
    # without the marks at the ends
    a, b = start.copy(), end.copy()
    odd = (kind[a] != 1) | (kind[b - 1] != 1)
    if odd.any():
        good = np.flatnonzero(kind == 1)
        lo, hi = np.searchsorted(good, a[odd]), np.searchsorted(good, b[odd])
        some = lo < hi
        k = np.flatnonzero(odd)
        a[k[some]], b[k[some]] = good[lo[some]], good[hi[some] - 1] + 1
        b[k[~some]] = a[k[~some]]
    full = np.flatnonzero(b > a)
    a, b = a[full], b[full]
    hashes = [words.hash, words.other][: 1 + both]
    sums = np.zeros((len(hashes), len(full)), np.uint64)
    k = 0
    while k < len(full):
        m = max(k + 1, int(np.searchsorted(b, a[k] + SPAN, "right")))
        base = int(a[k])
        size = int(b[m - 1]) - base
        if size <= SPAN:
            mixed = bits[points[base : base + size]]
            for row, (power, inverse) in zip(sums, powers):
                total = np.zeros(size + 1, np.uint64)
                np.cumsum(mixed * power[:size], out=total[1:])
                row[k:m] = (total[b[k:m] - base] - total[a[k:m] - base]) * inverse[a[k:m] - base]
                mixed = (mixed >> np.uint64(32)) | (mixed << np.uint64(32))
        k = m
    for k in np.flatnonzero(b - a > LONGEST).tolist():
        mixed = bits[points[a[k] : b[k]]].tobytes()
        sums[:, k] = [xxhash.xxh3_64_intdigest(mixed, seed) for seed in range(len(hashes))]
    for column, row in zip(hashes, sums):
        column[full] = mix(row + (b - a).astype(np.uint64) * MULT) | np.uint64(1)
    return words


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, without zeros, of the words of all texts, and each text's number of them."""
    words = read_words(texts)
    some = words.hash != 0
    return words.hash[some], np.bincount(words.text[some], minlength=len(texts))


def both_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, with two rows of hashes: 128 bits of each word."""
    words = read_words(texts, both=True)
    some = words.hash != 0
    return np.stack([words.hash[some], words.other[some]]), np.bincount(words.text[some], minlength=len(texts))


def shingles(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts, one after another, and each text's number of them. A text of
    1 to n - 1 words has one shingle, of all its words; a text without words has none."""
    return ngrams(*word_hashes(texts), n)


def ngrams(flat: np.ndarray, sizes: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, of the texts' word hashes."""
    short = (sizes > 0) & (sizes < n)
    if short.any():
        wide = np.where(short, n, sizes)
        shift = np.cumsum(wide - sizes) - (wide - sizes)
        padded = np.zeros(int(wide.sum()), np.uint64)
        padded[np.arange(len(flat)) + np.repeat(shift, sizes)] = flat
        flat, sizes = padded, wide
    h = grams(flat, n)
    keep = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)
    for k in range(1, n):
        keep[ends[sizes >= k] - k] = False
    return h[keep], np.maximum(sizes - (n - 1), 0)


def grams(flat: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """At each word, a hash of it and the n - 1 next ones (of zeros past the end)."""
    total = len(flat)
    flat = np.concatenate([flat, np.zeros(n, np.uint64)])
    h = flat[:total].copy()
    for k in range(1, n):
        h *= MULT
        h ^= h >> np.uint64(32)
        h += flat[k : k + total]
    return mix(h)


def choose_bands(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows of the longest bands that find a pair of this similarity with this probability, with
    at most `most` hashes: 1 - (1 - s^r)^b >= recall."""
    found = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most:
            found = bands, rows
    if found is None:
        raise ValueError("no bands reach this recall")
    return found


def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    return rng.integers(0, 1 << 32, k, np.uint32), rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(hashes: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys, one row of `bands` 64-bit keys per text; texts without shingles get zeros."""
    out = np.zeros((len(sizes), bands), np.uint64)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    out[full] = range_keys(hashes, (ends - sizes)[full], ends[full], bands, rows)
    return out


def range_keys(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys of ranges of hashes, none of them empty, one row of `bands` 64-bit keys per range."""
    out = np.zeros((len(start), bands), np.uint64)
    if not len(start):
        return out
    bounds = np.stack([start, end], 1).ravel()
    low = np.r_[hashes.astype(np.uint32), np.uint32(0)]
    h, high = np.empty_like(low), np.empty_like(low)
    flip, odd = _constants(bands * rows)
    for b in range(bands):
        key = np.full(len(start), b + 1, np.uint64)
        for r in range(b * rows, b * rows + rows):
            np.bitwise_xor(low, flip[r], out=h)
            np.multiply(h, odd[r], out=h)
            np.right_shift(h, 15, out=high)
            np.bitwise_xor(h, high, out=h)
            key = mix(key * MULT + np.minimum.reduceat(h, bounds)[::2].astype(np.uint64))
        out[:, b] = key
    return out
