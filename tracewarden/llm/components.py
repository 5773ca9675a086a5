"""Connected components of an undirected graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, hot_limit, join_counted


def _hooked(edges: DataFrame, limit: int) -> DataFrame:
    """Large star: every larger neighbour of a node is hooked to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return join_counted(both, least, "a", limit).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _gathered(edges: DataFrame, limit: int) -> DataFrame:
    """Small star: a node and its lesser neighbours are hooked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_counted(down, least, "a", limit).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots; root is the least node of the component.

    Alternating large and small stars until nothing changes, about log(n) rounds whatever the components' shape.
    A node's neighbours meet only in aggregates that combine before the shuffle and in joins against one row a node, in
    which the edges of a hub stay where they are. Self loops and repeated edges change nothing.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        limit = hot_limit(2 * state[0])
        now = cut(_gathered(_hooked(now, limit), limit), 2 * state[0])
