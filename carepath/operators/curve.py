"""Clustering by several columns at once: rows along a Z-order curve, so that files hold narrow ranges of each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a column are 2^BITS; their bounds are quantiles of about SAMPLE rows.
BITS, SAMPLE = 6, 20_000


def quantile_bounds(df: DataFrame, columns: Sequence[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list]:
    """Of each column the values (at most 2^bits - 1) at which ranges of about as many rows begin, by a sample: they
    decide where rows lie, never which rows there are."""
    n = df.count()
    part = df.select(*columns).sample(min(1.0, 1.5 * sample / max(1, n)), seed=1).limit(sample).collect()
    out = {}
    for k, column in enumerate(columns):
        values = sorted(r[k] for r in part if r[k] is not None)
        cuts = [values[len(values) * i // (1 << bits)] for i in range(1, 1 << bits)] if values else []
        out[column] = sorted(set(cuts))
    return out


def range_of(column: str, bounds: list) -> Column:
    """How many bounds a value reaches: its range, nulls in the first. A search by halves, six comparisons for 63."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) >= F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def z_order(bounds: dict[str, list]) -> Column:
    """The ranges' bits taken in turn, the highest first."""
    bits = max((len(b).bit_length() for b in bounds.values()), default=0)
    places = []
    for c, (column, cuts) in enumerate(bounds.items()):
        # spread over all bits, so that a column of few values counts as much as one of many
        span = F.floor(range_of(column, cuts) * ((1 << bits) / (len(cuts) + 1))).cast("long")
        places += [F.shiftleft(F.shiftright(span, b).bitwiseAND(1), b * len(bounds) + len(bounds) - 1 - c) for b in range(bits)]
    return reduce(Column.bitwiseOR, places, F.lit(0).cast("long"))


def cluster(df: DataFrame, columns: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """The rows dealt to about `files` parts along the curve: filters on any of the columns leave most files out."""
    order = z_order(quantile_bounds(df, columns, bits))
    return df.withColumn("_z", order).repartitionByRange(files, "_z").sortWithinPartitions("_z", *columns).drop("_z")
