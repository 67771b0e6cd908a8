"""What the training-data operators share: scratch tables, checked broadcasts, Arrow streaming."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import delete, owned, scratch, shared_dir, written

__all__ = [
    "delete", "drop_written", "join_ids", "join_sized", "map_batches", "owned", "partitions", "pieces", "scratch", "shared_dir", "slices", "texts_of", "tidy", "written",
]

#: An id set of at most this many rows (about 70 bytes each as a hashed relation, so 14 MB) is broadcast; a larger
#: one is shuffled.
BROADCAST_IDS = 200_000


def drop_written(df: DataFrame) -> None:
    """Delete a table made by `written` once nothing needs it."""
    delete(df.sparkSession, [os.path.dirname(file) for file in df.inputFiles()[:1]])


def join_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Semi, anti or inner join by id. `ids` must be cheap to read twice (a written table): its size is counted,
    and it is broadcast up to BROADCAST_IDS rows and shuffled beyond."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


#: A key is hot when it holds more than LEAST_HOT rows and more than one in HOT of all rows; so fewer than HOT are.
HOT, LEAST_HOT = 10_000, 1_000


def join_sized(rows: DataFrame, side: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join with a side that has one row per key and, in column `size`, how many of `rows` that key has. Both
    must be cheap to read twice (written tables). A side of at most BROADCAST_IDS rows is broadcast. Of a larger one
    the hot keys are, fewer than HOT, and only the others are shuffled, so no task gets a hot key's rows."""
    if side.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(side), keys)
    least = max(LEAST_HOT, (side.agg(F.sum(size)).first()[0] or 0) // HOT)
    hot, rest = side.where(F.col(size) > least), side.where(F.col(size) <= least)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(others)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a batch that a task turns into Python objects at a time.
ROWS = 1024


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def tidy() -> None:
    """Give the memory that a task is done with back to the system: workers are kept and used again."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = ROWS) -> DataFrame:
    """mapInArrow with a function of rows that is made once per task; it gets slices of the batches, of so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield from map(f, slices(batch, rows))
        tidy()

    return df.mapInArrow(run, schema)


def pieces(texts: list[str], most_chars: int = 1 << 20, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of rows with bounded text, so that the arrays made from them fit in a cache; a longer text stands alone."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and (chars + len(text) > most_chars or i - start >= most_rows):
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    """Null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]
