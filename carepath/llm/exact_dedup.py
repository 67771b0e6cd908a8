"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_ids, partitions, written

#: The characters that do not count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Room for a doc_id below the number of code points in one sortable decimal.
ROOM, TOP = str(10**20), str(2**63 - 1)
#: A group is hot when it holds more than LEAST_HOT rows and more than one in HOT of all rows; so fewer than HOT are.
HOT, LEAST_HOT = 10_000, 1_000


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when they are identical without BLANKS; null counts as empty, so null, empty and
    blank texts form one group. The row with the most code points in the original text stays, then the one
    with the smallest id. Rows that repeat an id and text are counted one by one; one of them stays by
    `keep_id`, and `kept` holds for each row with that id and length. Rows without an id are counted and
    grouped, but stay only when their group has no id at all (keep_id is then null). An empty table gives an
    empty table.

    Grouping by (hash, normalised text) makes Spark compare the bytes within a hash, and combines the
    copies in each task before the shuffle, so a group may hold any share of the rows. What is joined back
    is digests; a hash that two texts share is told apart by the second digest. The rows of hot groups are
    joined in as many parts as the group has times the least hot number of rows; which groups are hot is
    broadcast, fewer than HOT by their definition, and all parts together are fewer than 2 * HOT rows more.

    A text of any length is one value of a row. Columns of `docs` other than these two are not looked at,
    whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(text).alias("norm"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
    )
    room, top = F.lit(ROOM).cast("decimal(21,0)"), F.lit(TOP).cast("decimal(21,0)")
    rank = (F.col("n_chars").cast("decimal(10,0)") * room + (top - F.col("doc_id").cast("decimal(20,0)"))).cast("decimal(38,0)")
    digest = F.unhex(F.md5("norm"))
    groups = (
        rows.withColumn("rank", rank)
        .groupBy(digest.alias("h"), "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best")
    )
    groups = written(groups.coalesce(partitions(docs.sparkSession)), "exact-groups")
    least = max(LEAST_HOT, (groups.agg(F.sum("group_size")).first()[0] or 0) // HOT)
    parts = F.when(F.col("group_size") > least, F.ceil(F.col("group_size") / least)).otherwise(1).cast("int")
    hot = groups.where(F.col("group_size") > least).select("h", "text_sha256", parts.alias("parts"))
    groups = groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    members = rows.select("doc_id", digest.alias("h"), F.sha2("norm", 256).alias("text_sha256"), rank.alias("rank"))
    members = members.join(F.broadcast(hot), ["h", "text_sha256"], "left")
    members = members.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts").cast("int"), F.lit(0)))
    keep = top - F.col("best") % room
    return members.join(groups, ["h", "text_sha256", "part"]).select(
        "doc_id",
        keep.cast("long").alias("keep_id"),
        "group_size",
        F.coalesce(F.col("rank") == F.col("best"), F.col("best").isNull()).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Rows without an id always stay; so does each
    row that repeats the id of a row that stays, so no group loses its last text."""
    ids = exact_groups(docs, id_col, text_col).where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("stays"))
    gone = written(ids.where("not stays").select(f"`{id_col}`").coalesce(partitions(docs.sparkSession)), "exact-gone")
    return join_ids(docs, gone, id_col, "left_anti")
