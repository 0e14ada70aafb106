"""Exact nearest neighbours and local outlier factors without comparing all pairs.

Distinct points are ordered along a space-filling curve and cut into blocks of equal
size, so no cell can be hot; equal points are one point with a weight. Blocks are
grouped into wider nodes, each with its bounding box. A block's own points bound its
neighbour distance from above, and walking down the nodes keeps only those boxes that
lie within that bound. The remaining block pairs are compared point by point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridsight.functions.quantiles import quantile_values
from gridsight.functions.scale import broadcast_checked, row_numbers, saved
from gridsight.operators.anomaly import CONTAMINATION, feature_frame

BLOCK = 64
FANOUT = 32
CURVE_BITS = 20


def _squared(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [(x - y) * (x - y) for x, y in pairs])


def _gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(F.lit(0.0), low_b - high_a, low_a - high_b)


def _curve(names: list[str], low: dict[str, float], side: float) -> Column:
    """Position on a Z-order curve: the coordinates' bits, interleaved."""
    bits = max(1, min(CURVE_BITS, 62 // len(names)))
    cells = [F.least(F.lit(2 ** bits - 1), F.floor((F.col(n) - low[n]) / side * 2 ** bits)).cast("bigint") for n in names]
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for j, cell in enumerate(cells):
            one = F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(names) + j))
    return key


def weighted_points(frame: DataFrame, names: list[str]) -> DataFrame:
    """Distinct feature vectors with their ``weight``."""
    return frame.groupBy(*names).agg(F.count("*").alias("weight"))


def blocked_points(points: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """Adds a point number and its block along the curve; saved."""
    ends = points.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    low = {n: ends[f"lo_{n}"] for n in names}
    side = max((ends[f"hi_{n}"] - ends[f"lo_{n}"] for n in names), default=0.0) or 1.0
    keyed = points.withColumn("_z", _curve(names, low, side))
    keyed = saved(keyed)
    numbered = row_numbers(keyed, [F.col("_z"), *[F.col(n) for n in names]], "point")
    return saved(numbered.drop("_z").withColumn("block", F.floor((F.col("point") - 1) / block)))


def _boxes(points: DataFrame, names: list[str], key: Column) -> DataFrame:
    return points.groupBy(key.alias("node")).agg(
        *[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names])


def _parents(boxes: DataFrame, names: list[str]) -> DataFrame:
    return boxes.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(
        *[F.min(f"lo_{n}").alias(f"lo_{n}") for n in names], *[F.max(f"hi_{n}").alias(f"hi_{n}") for n in names])


def near_blocks(points: DataFrame, names: list[str], reach: DataFrame) -> DataFrame:
    """Pairs ``block, other`` of blocks whose boxes lie within the block's ``reach``.

    ``reach`` has one row per block (``block, reach2``, a squared distance). Pairs grow
    level by level from the widest nodes; a level's children are matched on their
    parent node, so the work follows the pairs that survive, not all pairs.
    """
    leaves = saved(_boxes(points, names, F.col("block")))
    levels = [leaves]
    size = leaves.count()
    while size > FANOUT:
        levels.append(saved(_parents(levels[-1], names)))
        size = levels[-1].count()
    mine = leaves.select(F.col("node").alias("block"), *[F.col(f"{e}_{n}").alias(f"{e}q_{n}") for e in ("lo", "hi") for n in names]).join(reach, "block")
    mine = saved(mine)

    def close(frame: DataFrame) -> DataFrame:
        gaps = [_gap(F.col(f"loq_{n}"), F.col(f"hiq_{n}"), F.col(f"lo_{n}"), F.col(f"hi_{n}")) for n in names]
        return frame.where(reduce(lambda a, b: a + b, [g * g for g in gaps]) <= F.col("reach2"))

    # The widest level has at most FANOUT nodes, so each block meets them as an array.
    top = levels[-1]
    listed = top.agg(F.collect_list(F.struct(*top.columns)).alias("t"))
    pairs = close(mine.select("*", F.explode(listed.scalar()).alias("t")).select(*mine.columns, "t.*")).select("block", "node")
    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.floor(F.col("node") / FANOUT))
        step = pairs.withColumnRenamed("node", "parent").join(broadcast_checked(children), "parent").drop("parent")
        pairs = saved(close(step.join(mine, "block")).select("block", "node"))
    return pairs.withColumnRenamed("node", "other")


def nearest(points: DataFrame, names: list[str], k: int) -> DataFrame:
    """``point, other, distance, taken``: the k nearest, counting a point's equals.

    A neighbour of weight w stands for w rows; ``taken`` is how many of them are among
    the k. A point's own equals come first, at distance 0.
    """
    bare = points.select("point", "block", "weight", *names)
    left = bare.select("point", "block", F.col("weight").alias("own"), *[F.col(n).alias(f"a_{n}") for n in names])
    right = bare.select(F.col("point").alias("other"), F.col("block").alias("other_block"), "weight", *[F.col(n).alias(f"b_{n}") for n in names])
    apart = _squared([(F.col(f"a_{n}"), F.col(f"b_{n}")) for n in names])
    order = W.partitionBy("point").orderBy("d2", "other")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    usable = F.when(F.col("point") == F.col("other"), F.col("own") - 1).otherwise(F.col("weight"))

    def ranked(pairs: DataFrame) -> DataFrame:
        # k neighbours of positive weight always suffice, so at most k + 1 rows are ranked.
        few = pairs.withColumn("weight", usable).where(F.col("weight") > 0).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k)
        return few.withColumn("before", before).where(F.col("before") < k)

    # Within the own block: an upper bound of each point's k-distance.
    own = left.join(right.withColumnRenamed("other_block", "block"), "block").withColumn("d2", apart)
    bound = ranked(own).groupBy("point", "block").agg(F.max("d2").alias("bound2"), F.sum("weight").alias("found"))
    # A last, short block may hold fewer than k rows; it has no bound of its own.
    bound = saved(left.select("point", "block").join(bound, ["point", "block"], "left").withColumn(
        "bound2", F.when(F.col("found") >= k, F.col("bound2")).otherwise(F.lit(float("inf")))).drop("found"))
    reach = bound.groupBy("block").agg(F.max("bound2").alias("reach2"))
    pairs = near_blocks(points, names, reach)
    candidates = (
        left.join(bound.drop("block"), "point").join(pairs.withColumnRenamed("other", "other_block"), "block")
        .join(right, "other_block").withColumn("d2", apart).where(F.col("d2") <= F.col("bound2"))
    )
    return ranked(candidates).select("point", "other", F.sqrt("d2").alias("distance"),
                                     F.least(F.col("weight"), F.lit(k) - F.col("before")).alias("taken"))


def local_outlier_factor(df: DataFrame, features: list[str], keep: list[str] = (), k: int = 20) -> DataFrame:
    """``keep…, features…, lof``: density around a row's neighbours over its own density."""
    names = [f"f{i}" for i in range(len(features))]
    frame = feature_frame(df, features, list(keep))
    total = frame.count()
    if total < 10:
        raise ValueError(f"local outlier factor needs at least 10 rows, got {total}")
    k = min(k, total - 1)
    points = blocked_points(weighted_points(frame, names), names, max(BLOCK, k + 1))
    near = saved(nearest(points, names, k))
    reach = near.groupBy("point").agg(F.max("distance").alias("k_distance"))
    edges = near.join(reach.withColumnsRenamed({"point": "other", "k_distance": "other_k"}), "other")
    density = saved(edges.groupBy("point").agg(
        (F.sum("taken") / (F.sum(F.col("taken") * F.greatest("other_k", "distance")) + 1e-10 * F.sum("taken"))).alias("lrd")))
    around = near.join(density.withColumnsRenamed({"point": "other", "lrd": "other_lrd"}), "other").groupBy("point").agg(
        (F.sum(F.col("taken") * F.col("other_lrd")) / F.sum("taken")).alias("around"))
    factor = around.join(density, "point").select("point", (F.col("around") / F.col("lrd")).alias("lof"))
    scored = points.join(factor, "point").select(*names, "lof")
    # A hot vector is one scored row; the row side may be skewed, the scored side is not.
    out = frame.join(scored, names)
    return out.select(*keep, *[F.col(n).alias(c) for n, c in zip(names, features) if c not in keep], "lof")


def lof_anomalies(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Rows whose factor is over the ``1 - contamination`` quantile, most severe first."""
    fixed = saved(scored)
    cut = quantile_values(fixed, ["lof"], [1 - contamination])["lof"][1 - contamination]
    return fixed.where(F.col("lof") > cut).withColumn("anomaly_score", F.round("lof", 4)).drop("lof").orderBy(F.desc("anomaly_score"))
