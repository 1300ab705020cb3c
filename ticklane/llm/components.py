"""Connected components by alternating large-star and small-star steps, all of it joins and minima.

Defined cases: an edge of a node with itself and one with a null end are no edges; repeated edges count once; nodes without
an edge are not returned; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import Scratch, join_totals


def _least(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """a, b, m (the least b of a) of every edge, and a, m alone. A hub's edges stay where they are."""
    least = scratch.cut(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    return join_totals(edges, least, ["a"], "n", least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), least


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every neighbour above a node goes to the least node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, _ = _least(both, scratch)
    return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every neighbour below a node, and the node, go to the least of them."""
    joined, least = _least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), scratch)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges (a, b longs): the least node that it reaches.

    Each round is written to the shared folder, so lineage stays short and lost executors cost a round at most.  A hub is
    never gathered: its neighbours are only joined with its minimum, where they are.  Rounds needed grow with the logarithm
    of the size; every round makes labels smaller or is the last.
    """
    now = scratch.cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(now)
    while before[0]:
        wide = scratch.cut(_large(now, scratch))
        after = scratch.cut(_small(wide, scratch).where(F.col("a") != F.col("b")).distinct())
        scratch.drop(wide)
        scratch.drop(now)
        now, fresh = after, mark(after)
        if fresh == before:
            break
        before = fresh
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
