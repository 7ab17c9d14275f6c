"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined in the map tasks, so a node with very many neighbours costs
no more than another) and an equi-join; the edges between steps lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import work_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b), a != b, each pair once in either direction."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return moved.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node long, component long): the least node reachable, for every node
    of an edge. Self-loops, repeated edges, either direction and an empty table are fine; null ends are
    passed over."""
    now = work_table(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = work_table(_star(_star(now, True), False), "edges")
        # a fixed point has one edge from each node to its component; equal sums twice: nothing moved
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = mark
