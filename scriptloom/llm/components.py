"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import drop, join_by_key, settle


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node in ``edges`` (columns a and b, long).

    Large star: every larger neighbour of a node is tied to the least node around it; small star: every smaller neighbour and
    the node itself are. Each step aggregates before it shuffles and keeps a row per edge at most; the edges of a hub stay where they lie, and the
    hub's least neighbour goes to them. The number of steps grows with the logarithm of the longest path.
    """
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # done once the edges are stars: one edge for each larger node, and no node on both sides
        state = now.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        if state["most"] == 0 or (state["most"] == 1 and now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()):
            break
        both = settle(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")))
        large = join_by_key(both, least, ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.filter("a <> b").distinct())
        down = settle(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_by_key(large, down, ["a"], "n").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = settle(small.unionByName(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        for old in (now, both, least, large, down):
            drop(old)
        now = new
    # stars: every edge leads to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct()
