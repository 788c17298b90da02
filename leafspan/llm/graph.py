"""Connected components by alternating star contraction, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written out, so that the join is an exchange away from the grouping and Spark can split a node of many links.
    low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    edges: two BIGINT columns; direction, repeats, loops and nulls are ignored.
    The rounds grow with the logarithm of the longest path. Each one ends in a
    checkpoint, and only a count and a sum come to the driver.
    """
    now = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _signature(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)))
        then, seen = seen, _signature(now)
        if then == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
