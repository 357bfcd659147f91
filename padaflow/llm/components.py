"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them.  Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``edges(a, b)`` → ``(node, root)``, root being the least node reachable; a row for every node but the roots.

    Nodes are bigint.  Every round works by grouped minima and joins, so a node with very many
    edges is never gathered in one row, and each round is a written table.  Only a row count and
    a checksum reach the driver.  Empty input gives an empty table; loops and nulls are ignored.
    """
    now = edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
    now = scratch.table(now.where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), f"{tag}0")
    seen, k = None, 0
    while True:
        k += 1
        after = scratch.table(_small_star(_large_star(now)), f"{tag}{k}")
        mark = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        scratch.drop(f"{tag}{k - 1}")
        now = after
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
