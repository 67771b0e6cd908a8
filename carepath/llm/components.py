"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Each round at least halves the paths that remain, so this holds for 2^60 nodes.
MOST_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to (node, component): the smallest node that can be reached. Nodes without an
    edge are not listed; loops and repeated edges do no harm; no edges give an empty table.

    Alternates large-star and small-star steps, which keep the components: every node links its larger
    neighbours, then all its smaller ones, to its smallest. Each round is written to the shared folder.
    A hot node's edges are joined to its minimum, never gathered; minima are combined before the shuffle.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        drop_written(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
