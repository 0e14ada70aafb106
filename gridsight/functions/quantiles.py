"""Exact interpolated quantiles without gathering a column into one task.

The built-in ``percentile`` keeps every distinct value of a group in one map. Here a
sketch (``percentile_approx``) first gives, for each wanted quantile, two values that
are certain to bracket it. The ends of all brackets cut the numbers into runs; a second
pass counts the rows of each run and the frequency of each value inside a bracket. Only
about ``4 / accuracy`` of the rows are inside, and those are ranked. The answer equals
linear interpolation between order statistics.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame, Window as W, functions as F

from gridsight.functions.parsing import measures
from gridsight.functions.scale import broadcast_checked, saved

ACCURACY = 100_000
# Per key a coarser sketch: it is smaller, and a key has fewer rows to rank.
KEYED_ACCURACY = 10_000


def quantiles(df: DataFrame, columns: list[str], probs: list[float], keys: list[str] = ()) -> DataFrame:
    """Rows ``keys…, column, prob, n, value``."""
    long = measures(df, columns, keep=list(keys))
    group = [*keys, "column"]
    wanted = [float(p) for p in probs]
    accuracy = KEYED_ACCURACY if keys else ACCURACY
    # The sketch is off by at most n / accuracy ranks, half the slack.
    slack = 2.0 / accuracy
    lows = F.array(*[F.lit(max(0.0, p - slack)) for p in wanted])
    highs = F.array(*[F.lit(min(1.0, p + slack)) for p in wanted])
    sketch = long.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.percentile_approx("x", lows, accuracy).alias("lo"),
        F.percentile_approx("x", highs, accuracy).alias("hi"),
    )
    # Without keys there is a row per column; with keys their number is checked.
    sketch = broadcast_checked(saved(sketch)) if keys else F.broadcast(sketch)
    places = range(len(wanted))
    x, low, high = F.col("x"), F.col("lo"), F.col("hi")
    run = reduce(add, [(x >= low[i]).cast("int") + (x > high[i]).cast("int") for i in places])
    inside = reduce(or_, [(x >= low[i]) & (x <= high[i]) for i in places])
    counted = (
        long.join(sketch, group)
        .groupBy(*group, "n", run.alias("run"), F.when(inside, x).alias("at"))
        .agg(F.count("*").alias("copies"), F.min("x").alias("least"), F.max("x").alias("most"))
    )
    order = W.partitionBy(*group).orderBy("run", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("last", F.sum("copies").over(order) - 1).withColumn("first", F.col("last") - F.col("copies") + 1)

    # Rounding ranks may ask for the value just outside a bracket: a run's first or last.
    def value_at(rank):
        value = F.when(F.col("last") == rank, F.col("most")).otherwise(F.col("least"))
        return F.max(F.when((F.col("first") <= rank) & (F.col("last") >= rank), F.coalesce("at", value)))

    place = [F.lit(p) * (F.col("n") - 1) for p in wanted]
    ends = ranked.groupBy(*group, "n").agg(F.array(*[
        F.struct(F.lit(p).alias("prob"), value_at(F.floor(place[i])).alias("a"), value_at(F.ceil(place[i])).alias("b")) for i, p in enumerate(wanted)]).alias("v"))
    one = ends.select(*group, "n", F.explode("v").alias("v"))
    at = F.col("v.prob") * (F.col("n") - 1)
    value = F.col("v.a") + (F.col("v.b") - F.col("v.a")) * (at - F.floor(at))
    return one.select(*group, F.col("v.prob").alias("prob"), "n", value.alias("value"))


def quantile_values(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, dict[float, float]]:
    """The quantiles of whole columns as numbers: at most columns x probs values."""
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for row in quantiles(df, columns, probs).collect():
        out[row["column"]][row["prob"]] = row["value"]
    return out


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    values = quantile_values(df, columns, [0.5])
    return {c: values[c].get(0.5) for c in columns}
