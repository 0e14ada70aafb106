"""Segments by quantile, width, category or fixed bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.parsing import as_text, missing, number
from gridsight.functions.quantiles import quantile_values

QUARTILES = ["Bottom Quartile", "Lower-Middle Quartile", "Upper-Middle Quartile", "Top Quartile"]


def _bins(df: DataFrame, metric: str, edges: list[float], labels: list[str] | None) -> DataFrame:
    """Counts per right-closed bin; the first bin also holds its left edge."""
    x = number(df, metric)
    slot = F.lit(len(edges) - 2)
    for i in range(len(edges) - 2, -1, -1):
        slot = F.when(x <= edges[i + 1], i).otherwise(slot)
    slots = df.sparkSession.createDataFrame(
        [(i, labels[i] if labels else f"Bin {i + 1}", float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)],
        "bin int, segment string, range_start double, range_end double")
    counts = df.where(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("c"))
    return slots.join(counts, "bin", "left").select("bin", "segment", "range_start", "range_end", F.coalesce("c", F.lit(0)).alias("count"))


def equal_frequency(df: DataFrame, metric: str, bins: int = 3, labels: list[str] | None = None) -> DataFrame:
    """Bins of equal counts; bins whose edges coincide are merged."""
    probs = [i / bins for i in range(bins + 1)]
    values = quantile_values(df, [metric], probs)[metric]
    if not values:
        raise ValueError(f"no numbers in {metric!r}")
    edges = sorted(set(values.values()))
    if len(edges) == 1:
        edges = [edges[0], edges[0]]
    fits = labels if labels and len(labels) == len(edges) - 1 else None
    return _bins(df, metric, edges, fits)


def quartiles(df: DataFrame, metric: str) -> DataFrame:
    return equal_frequency(df, metric, 4, QUARTILES)


def equal_width(df: DataFrame, metric: str, bins: int = 3) -> DataFrame:
    """Bins of equal width; the lowest edge is moved down by 0.1 % of the range."""
    x = number(df, metric)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError(f"no numbers in {metric!r}")
    lo, hi = row["lo"], row["hi"]
    if lo == hi:
        lo, hi = lo - (0.001 * abs(lo) or 0.001), hi + (0.001 * abs(hi) or 0.001)
        edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    else:
        edges = [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
        edges[0] -= (hi - lo) * 0.001
    return _bins(df, metric, edges, None)


def categories(df: DataFrame, dimension: str) -> DataFrame:
    return (df.where(~missing(df, dimension)).groupBy(as_text(df, dimension).alias("segment"))
            .agg(F.count("*").alias("count")))


def ratio_buckets(df: DataFrame, ratio: str, low: float = 90.0, high: float = 100.0) -> DataFrame:
    """Fixed bounds on a combined ratio: below 90, 90 to 100, above 100."""
    x: Column = number(df, ratio)
    counts = [("Low Risk (<90% Combined Ratio)", x < low), ("Medium Risk (90-100% Combined Ratio)", (x >= low) & (x <= high)),
              ("High Risk (>100% Combined Ratio)", x > high)]
    one = df.agg(*[F.count_if(test).alias(f"c{i}") for i, (_, test) in enumerate(counts)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("segment"), F.col(f"c{i}").alias("count")) for i, (label, _) in enumerate(counts)])).alias("s")).select("s.*")


def risk_label(ratio: Column) -> Column:
    return (F.when(ratio < 90, "Low Risk (Profitable)").when(ratio < 100, "Medium Risk (Near Breakeven)")
            .otherwise("High Risk (Underwriting Loss)"))
