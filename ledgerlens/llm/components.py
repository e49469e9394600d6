"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node it is connected to.

    Each round is written to the shared folder, so lineage stays short; the number of rounds
    grows with the logarithm of a component's width, not with its size. A hub node is a hot key
    of a join only, which adaptive execution splits.
    """
    spark = edges.sparkSession
    state = cut(spark, edges.where("a != b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        state = cut(spark, _small_star(_large_star(state)), "edges")
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionAll(stars.select(F.col("label").alias("node"), "label").distinct())
