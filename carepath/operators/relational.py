"""Operators on DataFrames that the engine's plans are made of. All are lazy and use built-ins only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most rows of a literal that is broadcast as a code table.
SMALL_ROWS = 100_000
#: Rows of a task that sorts or groups by key. Spark joins small partitions by their compressed bytes, so a task's
#: memory would grow with the table.
TASK_ROWS = 300_000


def pick(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the named columns that is not null; columns that the frame lacks count as null."""
    have = {c.lower() for c in df.columns}
    found = [F.col(n).cast(kind) for n in names if n.split(".")[0].lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def parts_of(rows: int) -> int | None:
    """Partitions for a table of so many rows, in proportion to them; None, which leaves it to Spark, for a small one."""
    return -(-rows // TASK_ROWS) if rows > 4 * TASK_ROWS else None


def dealt(df: DataFrame, by: Sequence[str], parts: int | None) -> DataFrame:
    """`df` dealt by key; windows and groups by that key, and joins of frames dealt alike, keep to these partitions."""
    return df.repartition(parts, *by) if parts else df


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in have})


def apply_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on each option that is given; an option that is None is no filter."""
    return reduce(lambda d, p: d.where(F.col(p[0]) == F.lit(p[1])), ((k, v) for k, v in wanted.items() if v is not None), df)


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the given (total) order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def sessionize(df: DataFrame, by: Sequence[str], day: str, gap_days: int, out: str = "episode_seq") -> DataFrame:
    """Number sessions per key: a row more than `gap_days` after the one before starts a new one."""
    w = Window.partitionBy(*by).orderBy(day)
    gap = F.datediff(F.col(day), F.lag(day).over(w))
    flagged = df.withColumn("_new", F.when(gap.isNull() | (gap > gap_days), 1).otherwise(0))
    return flagged.withColumn(out, F.sum("_new").over(w).cast("int")).drop("_new")


def gap_dedup(df: DataFrame, by: Sequence[str], day: str, gap_days: int, ties: Sequence[str] = ()) -> DataFrame:
    """Rows that are the first of their key or more than `gap_days` after the row before, kept or not."""
    w = Window.partitionBy(*by).orderBy(day, *ties)
    gap = F.datediff(F.col(day), F.lag(day).over(w))
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > gap_days)).drop("_gap")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, right_order: Sequence[str] = ()) -> DataFrame:
    """Each left row with the right row of its key whose time is the latest not after the left one's; left rows
    without one keep nulls. Of right rows with the same time the last by `right_order` counts.

    Both sides are merged into one timeline per key and the last right row is carried forward, so the work is
    linear in the rows of a key; a join of all earlier rows would be quadratic. Sides that are `dealt` alike are not shuffled again.
    """
    values = [c for c in right.columns if c not in by]
    packed = F.struct(*[F.col(c) for c in values])
    side = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in left.columns if c not in by]).alias("_left"))
    other = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(right_order)], packed.alias("_right"))
    line = side.unionByName(other, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), *[F.col(f"_o{k}") for k in range(len(right_order))]]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = line.withColumn("_match", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    # a null key or time matches nothing
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, "_t"]])
    match = F.when(known, F.col("_match"))
    own = [F.col(c).cast(left.schema[c].dataType).alias(c) if c in by else F.col(f"_left.{c}") for c in left.columns]
    return joined.select(*own, *[match.getField(c).alias(c if c not in left.columns else f"right_{c}") for c in values])


def nearest_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, max_days: int, left_key: Sequence[str], right_order: Sequence[str] = ()) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time, at most `max_days` away either way;
    of equally near ones the first by `right_order`. `left_key` tells left rows apart.

    Rows meet only in the same or the next bucket of 2 * max_days + 1 days, so the join is an equi join on key
    and bucket, and a key with a long history does not meet itself as a whole.
    """
    span = 2 * max_days + 1
    epoch = F.lit("1970-01-01").cast("date")
    bucket = lambda c, shift: F.floor((F.datediff(F.col(c), epoch) + shift) / span)
    values = [c for c in right.columns if c not in by]
    r = right.select(*by, *[F.col(c).alias(f"_r_{c}") for c in values], bucket(right_time, 0).alias("_b"))
    days = left.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(left_time, -max_days), bucket(left_time, max_days)))))
    gap = F.abs(F.datediff(F.col(left_time), F.col(f"_r_{right_time}")))
    near = days.join(r, [*by, "_b"]).withColumn("_gap", gap).where(F.col("_gap") <= max_days)
    near = latest_per_key(near, left_key, [F.col("_gap"), *[F.col(f"_r_{c}") for c in right_order]])
    picked = near.select(*left_key, *[F.col(f"_r_{c}").alias(c if c not in left.columns else f"right_{c}") for c in values])
    return left.join(picked, list(left_key), "left")


def cube_with_all(df: DataFrame, dims: Sequence[str], measures: Sequence[Column], known: dict[str, Column] | None = None) -> DataFrame:
    """All combinations of the dimensions, each also rolled up to "all" (null), in one pass over grouping sets.

    `known` says per dimension which rows have a group of their own; the others count in the totals only.
    Null means "all" and never a value that is missing.
    """
    known = known or {}
    own = {d: f"_has_{d}" for d in dims}
    marked = df.withColumns({own[d]: known.get(d, F.lit(True)) & F.col(d).isNotNull() for d in dims})
    marked = marked.withColumns({d: F.when(F.col(own[d]), F.col(d)) for d in dims})
    out = marked.cube(*dims).agg(*[F.grouping(d).alias(f"_all_{d}") for d in dims], *measures)
    real = reduce(Column.__and__, [(F.col(f"_all_{d}") == 1) | F.col(d).isNotNull() for d in dims])
    return out.where(real).drop(*[f"_all_{d}" for d in dims])


def topk_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def keyed_upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The current rows with those of `incoming` in place of rows with the same key, and new ones added."""
    return current.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming, allowMissingColumns=True)


def scd2_diff(current: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str], today: Column) -> DataFrame:
    """A type-2 dimension after a load: unchanged rows stay, changed ones end today and get a new version, new
    ones begin today; absent ones stay. `current` has effective_date, end_date, is_current besides incoming's
    columns. Running it again on the same day changes nothing."""
    digest = lambda: F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in tracked]), 256)
    cols = incoming.columns
    now = current.where("is_current").withColumn("_hash", digest())
    new = incoming.withColumn("_new_hash", digest())
    history = current.where(~F.col("is_current"))
    seen = now.join(new.select(key, "_new_hash"), key, "left")
    changed = F.col("_new_hash").isNotNull() & (F.col("_hash") != F.col("_new_hash"))
    kept = seen.where(~F.coalesce(changed, F.lit(False))).select(*current.columns)
    ended = seen.where(F.coalesce(changed, F.lit(False))).withColumns({"end_date": today, "is_current": F.lit(False)}).select(*current.columns)
    same = now.select(key, F.col("_hash").alias("_new_hash"))
    fresh = new.join(same, [key, "_new_hash"], "left_anti").select(*cols)
    fresh = fresh.withColumns({"effective_date": today, "end_date": F.lit("9999-12-31").cast("date"), "is_current": F.lit(True)})
    return history.unionByName(kept).unionByName(ended).unionByName(fresh.select(*current.columns))


def scd2_end(current: DataFrame, gone: DataFrame, key: str, today: Column) -> DataFrame:
    """A type-2 dimension in which the current rows of keys that are gone (rows of `gone`, one per key) end today."""
    marked = current.join(gone.select(key, F.lit(True).alias("_gone")).distinct(), key, "left")
    ends = F.col("is_current") & F.col("_gone").isNotNull()
    return marked.withColumns({"end_date": F.when(ends, today).otherwise(F.col("end_date")), "is_current": F.col("is_current") & ~ends}).select(*current.columns)


def paginate(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """One page of at most 100 rows in a total order."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page must be 1 or more, page_size 1 to 100")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def flow_edges(df: DataFrame, levels: Sequence[tuple[str, Column, Column, Column]], dim: str, values: Iterable[str], key: str, distinct: bool = True) -> DataFrame:
    """Edges between the steps of each row's path, counted by distinct key (with `distinct` off by rows, which are
    combined before the shuffle), for all rows (null) and for each of the dimension's values. A level is (category, source, target, condition)."""
    steps = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(k).alias("level"), F.lit(cat).alias("category"), src.alias("source"), dst.alias("target"))) for k, (cat, src, dst, cond) in enumerate(levels, 1)]),
        lambda s: s.isNotNull(),
    )
    rows = df.select(key, dim, F.explode(steps).alias("s")).select(key, dim, "s.*")
    everyone = F.lit(None).cast("string")
    rows = rows.withColumn("filter_value", F.explode(F.when(F.col(dim).isin(list(values)), F.array(everyone, F.col(dim))).otherwise(F.array(everyone))))
    return rows.groupBy("filter_value", "level", "category", "source", "target").agg((F.count_distinct(key) if distinct else F.count(F.lit(1))).alias("patient_count"))


def code_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed code map as a frame for broadcast joins; its size is that of the literal."""
    if len(rows) > SMALL_ROWS:
        raise ValueError("a code table is a small literal")
    return F.broadcast(spark.createDataFrame(list(rows), schema))
