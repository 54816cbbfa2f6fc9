"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkjourney.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung under the node's smallest neighbour (itself included)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b")


def _small_star(e: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are hung under the smallest of them."""
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    near = e.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("n"))
    return near.where("m < n").select(F.col("m").alias("a"), F.col("n").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that a
    link (a, b) touches with another node.  Links never leave Spark; a round
    costs two aggregates with partial combine and two joins, so a hub's edges
    are split by the adaptive skew join.  Rounds end when the edges are stars
    that no longer change (their number and sum stay)."""
    e = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    was = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was or now[0] == 0:
            break
        was = now
        e = cut(_small_star(_large_star(e).distinct()).distinct())
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
