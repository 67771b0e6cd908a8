"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal
equations, isotonic calibration."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_ids, map_batches, texts_of, written

#: The statistics of a text, in order.
STATISTICS = (
    "log characters", "log words", "letters", "upper-case letters", "digits", "bytes beyond ASCII", "sentence marks", "other marks", "white space",
    "mean word length", "distinct words", "most frequent word", "words like the one before", "words with a mark inside or unusual at the end",
    "all-capital words", "log lines", "repeated lines", "lines with a bar or tab", "log words a sentence",
)
#: At most about this many labelled rows are fitted on, drawn by a hash of the id: a bound on work, not on scoring.
MOST_LABELLED = 200_000
FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1.0, 7
#: Partitions whose sums go to the driver, each of (FEATURES + 2)^2 numbers.
SUMS = 16
#: Scores that calibration looks at, each with the sums of its labels.
BINS = 4096

_class = np.zeros(256, np.int64)  # 0 other marks, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 sentence marks, 6 white space
_class[97:123], _class[65:91], _class[48:58], _class[128:] = 1, 2, 3, 4
_class[[ord(c) for c in ".,;:?'\"-()"]] = 5
_class[[9, 10, 11, 12, 13, 32]] = 6


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; all zero for an empty one."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    other, lower, upper, digit, high, mark, blank = np.bincount(_class, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 7).tolist()
    words = text.split()
    k = len(words) or 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    m = len(lines) or 1
    odd = caps = 0
    for w, c in counts.items():
        if not w.isalpha():
            end = w.rstrip(".,;:?!'\")")
            if not end.isalnum():
                odd += c
        if len(w) > 1 and w.isupper():
            caps += c
    ends = raw.count(b". ") + raw.count(b".\n") + 1
    return [
        np.log1p(n), np.log1p(len(words)), (lower + upper + high) / n, upper / n, digit / n, high / n, mark / n, other / n, blank / n,
        min(40.0, n / k) / 40, len(counts) / k, max(counts.values(), default=0) / k, sum(map(operator.eq, words, words[1:])) / k, odd / k,
        caps / k, np.log1p(m), 1 - len(set(lines)) / m, sum("|" in x or "\t" in x for x in lines) / m, np.log1p(min(400.0, k / ends)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>), one row per row. Null counts as empty."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t) for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

        return f

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return map_batches(rows, make, "doc_id long, x array<double>")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id counts as the empty text, so it falls into fold 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # calibration: raw scores and what they stand for
    level: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.hstack([np.cos(z @ self.turn + self.shift), np.ones((len(z), 1))]) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.level)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _sums(rows: DataFrame, f, size: int) -> np.ndarray:
    """Sums over all rows of (x, y), by partition and then over the bounded number of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.select("x", "y").coalesce(SUMS).mapInArrow(run, "s binary").collect()
    return sum((np.frombuffer(p.s) for p in parts), np.zeros(size))


def isotonic(at: np.ndarray, weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to the values, by pooling adjacent violators. `at` is ascending."""
    level: list[list[float]] = []
    for w, v in zip(weight, value):
        level.append([w, v, 1])
        while len(level) > 1 and level[-2][1] >= level[-1][1]:
            w2, v2, n2 = level.pop()
            w1, v1, n1 = level.pop()
            level.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(n, v) for _, v, n in level]) if level else np.zeros(0)


def fit(labelled: DataFrame) -> Model:
    """`labelled` is a written table (doc_id, x, y, fold), without the held-out fold 0. Fold 4 calibrates, the
    others fit. Without any labelled row every score is 0.5."""
    d = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    turn = rng.normal(size=(d, FEATURES)) / WIDTH
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    train = labelled.where("fold <> 4")
    s = _sums(train, lambda x, y: np.r_[len(x), x.sum(0), (x * x).sum(0)], 1 + 2 * d)
    n = max(s[0], 1.0)
    mean = s[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(s[1 + d :] / n - mean**2, 0)) + 1e-6
    bare = Model(mean, scale, turn, shift, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if s[0] == 0:
        return bare
    size = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.hstack([np.cos((x - mean) / scale @ turn + shift), np.ones((len(x), 1))])
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    both = _sums(train, normal, size * (size + 1)).reshape(size, size + 1)
    penalty = np.eye(size) * RIDGE
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])
    raw = Model(mean, scale, turn, shift, weights, bare.at, bare.level)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip(((raw.raw(x) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(k, minlength=BINS), np.bincount(k, y, BINS)])

    count, good = _sums(labelled.where("fold = 4"), binned, 2 * BINS).reshape(2, BINS)
    if not count.sum():
        return Model(mean, scale, turn, shift, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    has = np.flatnonzero(count)
    at = (has + 0.5) / BINS * 3 - 1
    # one row of each label keeps the levels off 0 and 1
    level = isotonic(at, count[has] + 2.0 / len(has), (good[has] + 1.0 / len(has)) / (count[has] + 2.0 / len(has)))
    return Model(mean, scale, turn, shift, weights, at, np.clip(level, 0.0, 1.0))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Labels (doc_id, quality 0/1) are learnt from rows whose fold is not 0 only; a score comes from the text's
    statistics alone. At most about `most_labelled` labelled rows are fitted on, drawn by a hash of the id;
    every document is scored. Null counts as the empty text, which gets a score as well; a null doc_id stays
    null and counts as held out. Labels that are null or that no document has are passed by; where an id has
    several labels or rows, each pair counts. Empty tables give an empty table. Texts are read whole, and columns
    of `docs` other than the two are not read, whatever their names.
    """
    x = written(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.selectExpr("cast(doc_id as long) as doc_id", "cast(quality as double) as y").where("doc_id is not null and y is not null").withColumn("fold", fold()).where("fold <> 0")
    n = known.count()
    if n > most_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))
    known = written(known, "labels")
    fitted = fit(written(x.join(known, "doc_id"), "labelled"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = fitted.score(_matrix(batch.column(1)))
            columns = [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

        return f

    return map_batches(x.withColumn("held_out", fold() == 0), make, "doc_id long, held_out boolean, score double, predicted int")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns. Rows without an id stay; of rows that
    share an id all go if one is rejected; an empty table stays empty. No column is added, so no name clashes."""
    scores = quality_scores(docs, labels, threshold, id_col=id_col, text_col=text_col)
    gone = written(scores.where("predicted = 0 and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct(), "rejected")
    return join_ids(docs, gone, id_col, "left_anti")
