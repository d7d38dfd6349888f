"""Connected components of an edge table by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfgrade.staging import Staged, release, stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbours and itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(staged: Staged):
    return staged.frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it reaches.

    Minima are taken in the map tasks first, so a node with very many neighbours is no hot key; the
    number of rounds grows with the logarithm of the longest chain. Each round is a written table. Roots
    themselves are not listed.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = stage(_large_star(now.frame), "edges")
        small = stage(_small_star(large.frame), "edges")
        new = _state(small)
        release(spark, now.path)
        release(spark, large.path)
        now, old, state = small, state, new
        if old == new:
            break
    return now.frame.select(F.col("a").alias("node"), F.col("b").alias("root"))
