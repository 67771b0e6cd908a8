"""Vector code compression: product quantisation by Lloyd rounds whose sums are kept up by differences."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, join_sized, partitions, shared_dir, tidy, written

#: Components are whole numbers of 1 / SCALE; the largest value of a long, which errors stop at.
SCALE, MOST = 4096, 2**63 - 1
#: Sums beyond a long travel in limbs of this many bits.
LIMB = 62
#: Rows of a batch that a task codes at a time.
ROWS = 4096
DELTA = "array<struct<part: int, entry: int, limb: int, n: long, sums: array<long>>>"

#: Of each part, its entries; of each entry, its components as Python integers of any size.
Books = list[list[list[int]]]


def bounds(dim: int, parts: int) -> list[int]:
    """Where parts start and end; the first ones are longer by one if the parts can't be equal."""
    size, more = divmod(dim, parts)
    return [k * size + min(k, more) for k in range(parts + 1)]


def whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite x."""
    return math.floor(Fraction(x) * SCALE)


class Assign:
    """Assigns the parts of vectors to the nearest entries, exactly. Where all numbers are small enough, distances in
    float64 are whole numbers without error; elsewhere they tell only what is nearest beyond doubt, and Python's
    integers tell the rest and the distance."""

    def __init__(self, books: Books, dim: int):
        self.books, self.at = books, bounds(dim, len(books))
        with np.errstate(over="ignore"):
            self.points = [np.array([[_float(v) for v in entry] for entry in book], np.float64).reshape(len(book), b - a) for book, a, b in zip(books, self.at, self.at[1:])]

    def small(self, width: int) -> float:
        """Numbers up to this give distances of parts of this width below 2^53."""
        return math.sqrt(2**53 / max(1, width)) / 2 - 1

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Codes (rows x parts) and errors of float64 vectors."""
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(vectors * SCALE)
            codes = np.zeros((len(vectors), len(self.books)), np.uint8)
            near, far = np.zeros(len(vectors), np.int64), {}
            for k, (points, a, b) in enumerate(zip(self.points, self.at, self.at[1:])):
                x = scaled[:, a:b]
                d = ((x[:, None, :] - points[None, :, :]) ** 2).sum(2)
                code = d.argmin(1)
                least = d[np.arange(len(x)), code]
                limit = self.small(b - a)
                big = (np.abs(points) > limit).any(1) if b > a else np.zeros(len(points), bool)
                wide = ~(np.abs(x) <= limit).all(1)
                if big.any() or wide.any():
                    # sure: no other entry comes within the rounding of the nearest
                    others = d.copy()
                    others[np.arange(len(x)), code] = np.inf
                    sure = others.min(1) > least * (1 + 1e-9)
                    for i in np.flatnonzero(wide | big[code] | (big.any() & ~sure)).tolist():
                        part = [whole(v) for v in vectors[i, a:b].tolist()]
                        exact = [sum((p - q) ** 2 for p, q in zip(part, entry)) for entry in self.books[k]]
                        code[i] = min(range(len(exact)), key=exact.__getitem__)
                        far[i] = far.get(i, 0) + exact[code[i]]
                        least[i] = 0
                codes[:, k] = code
                near += least.astype(np.int64)
        errors = near.tolist()
        for i, more in far.items():
            errors[i] = min(MOST, errors[i] + more)
        return codes, errors

    def delta(self, vectors: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
        """What the parts whose entry changed add to their new entry and take from their old one."""
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(vectors * SCALE)
        for k, (book, a, b) in enumerate(zip(self.books, self.at, self.at[1:])):
            moved = np.flatnonzero(after[:, k] != before[:, k]) if before is not None else np.arange(len(after))
            if not len(moved):
                continue
            x = scaled[moved, a:b]
            wide = ~(np.abs(x) <= self.small(b - a)).all(1)
            n = np.zeros(len(book), np.int64)
            sums = np.zeros((len(book), b - a), np.int64)
            large: dict[int, list[int]] = {}
            for codes, sign in ((after, 1), (before, -1)):
                if codes is None:
                    continue
                entry = codes[moved, k]
                np.add.at(n, entry, sign)
                np.add.at(sums, entry[~wide], sign * x[~wide].astype(np.int64))
                for i in np.flatnonzero(wide).tolist():
                    have = large.setdefault(int(entry[i]), [0] * (b - a))
                    for c, v in enumerate(vectors[moved[i], a:b].tolist()):
                        have[c] += sign * whole(v)
            for e in np.flatnonzero((n != 0) | sums.any(1)).tolist():
                out.append({"part": k, "entry": e, "limb": 0, "n": int(n[e]), "sums": sums[e].tolist()})
            for e, values in large.items():
                for limb, digits in enumerate(_limbs(values)):
                    out.append({"part": k, "entry": e, "limb": limb, "n": 0, "sums": digits})
        return out


def _float(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return math.inf if v > 0 else -math.inf


def _limbs(values: list[int]) -> list[list[int]]:
    """Signed limbs, lowest first, of integers of any size."""
    out, mask = [], (1 << LIMB) - 1
    while any(values):
        out.append([(abs(v) & mask) * (1 if v >= 0 else -1) for v in values])
        values = [(abs(v) >> LIMB) * (1 if v >= 0 else -1) for v in values]
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def _each(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                yield f(batch.slice(a, ROWS))
        tidy()

    return run


def _codes(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


def _round(books: Books, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, embedding, code of the round before) to (row, code, delta), a batch's delta in its first row."""
    assign = Assign(books, dim)
    kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _vectors(batch.column(1))
        codes, _ = assign(vectors)
        old = batch.column(2)
        before = None if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(codes.shape)
        delta = assign.delta(vectors, before, codes) or None
        return pa.RecordBatch.from_arrays([batch.column(0), _codes(codes), pa.array([delta, *[None] * (len(codes) - 1)], kind)], names=["row", "code", "delta"])

    return _each(f)


def _final(books: Books, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, label, embedding) to (vec_id, label, code, error)."""
    assign = Assign(books, dim)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, errors = assign(_vectors(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _codes(codes), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return _each(f)


@contextmanager
def bucketed(spark: SparkSession, key: str, buckets: int) -> Iterator[tuple[Callable[[DataFrame, str], DataFrame], Callable[[str], None]]]:
    """Writes tables bucketed by `key` to the shared folder, so that joins by it need no shuffle, and drops them:
    by name, and all at the end."""
    made: dict[str, str] = {}

    def write(df: DataFrame, name: str) -> DataFrame:
        table = f"carepath_{name}_{uuid.uuid4().hex}"
        made[name] = table
        df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/carepath/{table}").saveAsTable(table)
        return spark.table(table)

    def drop(name: str) -> None:
        table = made.pop(name)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, [f"{shared_dir(spark)}/carepath/{table}"])

    try:
        yield write, drop
    finally:
        for name in list(made):
            drop(name)


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    values = F.col(vector_col)
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    label = F.col(label_col).cast("string")
    return vectors.where(values.isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), values.alias("embedding"))


def lloyd(spark: SparkSession, table: DataFrame, books: Books, dim: int, rounds: int, write: Callable, drop: Callable) -> Books:
    """The codebooks after so many rounds over a table (row, embedding) that `write` made.

    A round reads the vectors and the codes of the round before, bucket by bucket without a shuffle, and writes the
    new codes. What is shuffled is the pre-summed plus and minus of the parts that changed their entry; they are
    added to the running sums, which the driver holds: of each entry its number of parts and one integer per
    component, whatever the number of rows.
    """
    at = bounds(dim, len(books))
    sums = [[[0] * (b - a) for _ in book] for book, a, b in zip(books, at, at[1:])]
    counts = [[0] * len(book) for book in books]
    codes = None
    for r in range(rounds):
        if codes is None:
            rows = table.select("row", "embedding", F.lit(None).cast("binary").alias("code"))
        else:
            rows = table.select("row", "embedding").join(codes.select("row", "code").hint("merge"), "row")
        now = write(rows.mapInArrow(_round(books, dim), f"row long, code binary, delta {DELTA}"), f"codes_{r}")
        if codes is not None:
            drop(f"codes_{r - 1}")
        codes = now
        moves = codes.where("delta is not null").select(F.explode("delta").alias("d")).select("d.*")
        # one row per entry and limb, its components side by side
        width = max(b - a for a, b in zip(at, at[1:]))
        places = [F.sum(F.get("sums", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(width)]
        for part, entry, limb, n, *values in moves.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *places).collect():
            counts[part][entry] += n
            for place in range(at[part + 1] - at[part]):
                sums[part][entry][place] += int(values[place]) << (LIMB * limb)
        books = [
            [[s // n for s in total] if n else entry for entry, total, n in zip(book, totals, ns)]  # floor, below 0 too
            for book, totals, ns in zip(books, sums, counts)
        ]
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold a null, NaN or infinite component are dropped. A component x becomes the integer
    floor(4096 * x), exactly, however large; vectors are cut into `parts` consecutive parts (the first ones longer
    by one if the length is no multiple). Codebooks start as the parts of the vectors with the `entries` (up to 256)
    smallest ids, null last; of vectors that share an id the smallest; fewer ids give fewer entries. Each round
    assigns each part to its nearest entry, by squared Euclidean distance, the lower index if equal, and replaces
    each entry by the floored means of its parts; an entry without parts stays. `code` has the final entries' indexes, two
    hexadecimal digits each, `error` the sum of their squared distances, at most 2^63 - 1, `label_error` its sum over the rows with an
    equal label (nulls are equal; labels are compared as text), and `codebooks_sha256` is the digest of the final entries'
    components. All vectors must be of one length: those of another length than that of the smallest id (the
    shortest of several) are dropped. Empty vectors have code 0 and error 0. Rows that repeat are coded one by one,
    and an empty table gives an empty table. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    kept = _kept(vectors, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id())
    with bucketed(spark, "row", n) as (write, drop):
        table = write(kept.repartition(n, "row"), "vectors")
        first = table.select("vec_id", F.size("embedding").alias("dim")).orderBy(F.col("vec_id").asc_nulls_last(), "dim").first()
        dim = first["dim"] if first else 0
        table = table.where(F.size("embedding") == dim)
        ids = [r[0] for r in table.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
        among = F.col("vec_id").isin([i for i in ids if i is not None])
        seeds = table.where(among | F.col("vec_id").isNull() if None in ids else among).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).collect()
        seeds.sort(key=lambda r: (r[0] is None, r[0] or 0))
        at = bounds(dim, parts)
        whole_seeds = [[whole(float(x)) for x in r["embedding"]] for r in seeds]
        books = [[seed[a:b] for seed in whole_seeds] for a, b in zip(at, at[1:])]
        if seeds:
            books = lloyd(spark, table, books, dim, rounds, write, drop)
        final = table.select("vec_id", "label", "embedding").mapInArrow(_final(books, dim), "vec_id long, label string, code binary, error long")
        final = written(final, "vector-codes")
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    label = [F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label")]
    coded = final.select("vec_id", *label, "code", "error")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(20,0)")).cast("long")
    labels = written(coded.groupBy("none", "label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows")).coalesce(n), "label-errors")
    return join_sized(coded, labels, ["none", "label"], "rows").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
