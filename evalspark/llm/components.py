"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import ensure_checkpoint_dir


def _around(edges: DataFrame) -> DataFrame:
    """``(u, v, m)``: each edge once, with the smallest ``v`` around ``u``; one exchange."""
    return edges.repartition("u").distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _around(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    return _around(edges).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node that can be reached.

    Rounds grow with the logarithm of the longest chain. Each round is checkpointed, and takes three exchanges and no join: what
    a round adds to the driver is its plan. The first one reads ``links`` twice.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        edges = _small_star(_large_star(edges)).distinct().checkpoint()
        after = _state(edges)
        if after == before or not after[0]:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
