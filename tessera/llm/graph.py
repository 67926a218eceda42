"""Connected components of an edge table, by distributed union-find on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges -> (node, root): root is one node of the component, the same for all of them and in every run;
    isolated nodes do not appear.

    Each round gives every node the first node, in an order hashed anew, of those at most two edges away, and contracts
    the graph by these names: a star is one node after a round, and chains shrink by a constant factor. The least is
    taken twice over single edges, by partial aggregation, so a hub's edges never meet in one group unreduced. Two
    tables are written a round; whether edges are left is all that reaches the driver. Raises if some are left after
    max_rounds (they end in O(log n) rounds).
    """
    return written(edges.sparkSession, lambda: _contract(edges, max_rounds))


def _contract(edges: DataFrame, max_rounds: int) -> DataFrame:
    one = edges.select("a", "b").where("a <> b")
    left = cut(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    for k in range(max_rounds):
        if not left.limit(1).count():
            return labels
        rank = lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("rank"), F.col(x).alias("name"))  # noqa: E731,B023
        near = left.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("b"), F.least(rank("a"), "m").alias("m"))
        far = left.join(near, "b").groupBy("a").agg(F.min("m").alias("m"))
        step = cut(far.select(F.col("a").alias("old"), F.col("m.name").alias("new")))
        if not k:
            labels = step.select(F.col("old").alias("node"), F.col("new").alias("root"))
        else:
            moved = step.select(F.col("old").alias("root"), "new")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        ends = [step.select(F.col("old").alias(x), F.col("new").alias(f"_{x}")) for x in "ab"]
        left = cut(left.join(ends[0], "a").join(ends[1], "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
