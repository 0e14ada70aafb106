"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridsight.functions.scale import saved


def _nearest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node, itself included; saved, so that a join on it can be split."""
    return saved(edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``: the smallest node it is joined to.

    Each round points every node at the smallest node around it, first its larger
    neighbours (large star), then its smaller ones (small star), until nothing changes;
    the rounds grow with the logarithm of the longest chain. Only counts reach the driver. A
    node may become the centre of a huge star: its rows are met by a join on saved tables, which
    adaptive execution splits. Null ends and self-links join nothing.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(both.filter("v > u").join(_nearest(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        near = _nearest(large)
        edges = saved(large.join(near, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                      .unionByName(near.select("u", F.col("low").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.hash("v", "u").cast("bigint"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
