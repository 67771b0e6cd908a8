"""Statements for an interface: parameters, a deadline, rows as plain values, pages by key."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Seconds that a statement may take, and rows that it may return at once.
DEADLINE, MOST_ROWS = 30.0, 1000


class StatementTimeout(TimeoutError):
    """A statement was stopped at its deadline."""


class TooManyRows(ValueError):
    """A statement would return more rows than fit in one answer: page through it."""


def plain(value: object) -> object:
    """A cell as JSON knows it: numbers, text, truth values, lists and objects; days and times as ISO text."""
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """The jobs that this thread starts within are stopped after so many seconds, and no others."""
    tag, late = f"carepath-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    context = spark.sparkContext
    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise StatementTimeout(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _rows(df: DataFrame, most: int, seconds: float) -> list[dict]:
    with deadline(df.sparkSession, seconds):
        return [{k: plain(v) for k, v in r.asDict().items()} for r in df.limit(most).collect()]


def execute(spark: SparkSession, sql: str, params: dict[str, object] | None = None, seconds: float = DEADLINE, most: int = MOST_ROWS) -> list[dict]:
    """The rows of a statement with named parameters (`:name`). More than `most` rows raise TooManyRows, and a
    statement that runs longer than `seconds` is stopped and raises StatementTimeout."""
    found = _rows(spark.sql(sql, args=params or None), most + 1, seconds)
    if len(found) > most:
        raise TooManyRows(f"more than {most} rows")
    return found


def pages(rows: DataFrame, key: Sequence[str], size: int = MOST_ROWS, seconds: float = DEADLINE, after: Sequence[object] | None = None) -> Iterator[list[dict]]:
    """All rows once, in the order of `key`, in pages of `size`. The key's columns must be unique together and not
    null: a null ends in ValueError. A page begins after the last key of the one before (`after` for the first), so it costs a
    filtered top-k, not a sort of what has been read, and rows that come or go between pages shift none."""
    if size < 1:
        raise ValueError("a page has a row at least")
    at = F.struct(*key)
    kinds = rows.select(*key).schema
    while True:
        left = rows if after is None else rows.where(at > F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(after, kinds)]))
        with deadline(rows.sparkSession, seconds):
            found = left.orderBy(*[F.col(c).asc_nulls_first() for c in key]).limit(size).collect()
        if not found:
            return
        if any(r[c] is None for r in found for c in key):
            raise ValueError("a key is null")
        yield [{k: plain(v) for k, v in r.asDict().items()} for r in found]
        after = [found[-1][c] for c in key]
        if len(found) < size:
            return


def serve_pages(spark: SparkSession, sql: str, key: Sequence[str], handle: Callable[[list[dict]], None], params: dict[str, object] | None = None, size: int = MOST_ROWS, seconds: float = DEADLINE) -> int:
    """Hand a statement's pages to `handle` one by one; gives the number of rows."""
    n = 0
    for page in pages(spark.sql(sql, args=params or None), key, size, seconds):
        handle(page)
        n += len(page)
    return n
