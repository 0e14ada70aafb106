"""Aggregates shaped for charts: label and value rows, values to two decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.parsing import as_text, missing, moment, number
from gridsight.functions.quantiles import quantiles

DEFAULT_LIMIT = 15
SCATTER_POINTS = 5000


def aggregate_of(value: Column, method: str) -> Column:
    """sum, mean, max, min or count of a numeric column, as a double."""
    made = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}
    return made.get(method, F.count)(value).cast("double")


def _tidy(value: Column) -> Column:
    """Two decimals; a group without any number shows 0, never null or NaN.

    A mean may fall exactly between two cents. Rounding away the last digits first keeps
    the order of summation from deciding which way it goes.
    """
    return F.round(F.round(F.coalesce(value, F.lit(0.0)), 9), 2)


def categorical_chart(df: DataFrame, dimension: str, metric: str | None = None, method: str = "sum",
                      limit: int = DEFAULT_LIMIT, series: str | None = None) -> DataFrame:
    """The largest groups of a dimension; ``series`` splits each bar of the kept groups."""
    label = as_text(df, dimension).alias("label")
    keys = [label] + ([as_text(df, series).alias("series")] if series else [])
    value = number(df, metric) if metric else F.lit(1.0)
    cut = df.where(~missing(df, dimension)).select(*keys, value.alias("_v"))
    agg = aggregate_of(F.col("_v"), method if metric else "count")
    bars = cut.groupBy("label").agg(agg.alias("_raw")).orderBy(F.desc_nulls_last("_raw"), "label").limit(limit)
    if not series:
        return bars.select("label", _tidy(F.col("_raw")).alias("value"))
    return (cut.join(bars.select("label"), "label", "left_semi").groupBy("label", "series")
            .agg(_tidy(agg).alias("value")))


def monthly_chart(df: DataFrame, date_column: str, metric: str | None = None, method: str = "sum",
                  points: int | None = None) -> DataFrame:
    """One point per calendar month in order; all, or the first ``points`` months."""
    month = F.date_format(moment(df, date_column), "yyyy-MM").alias("label")
    value = number(df, metric) if metric else F.lit(1.0)
    out = (
        df.select(month, value.alias("_v")).where(F.col("label").isNotNull())
        .groupBy("label").agg(_tidy(aggregate_of(F.col("_v"), method if metric else "count")).alias("value"))
        .orderBy("label")
    )
    return out.limit(points) if points else out


def kpi_tile(df: DataFrame, metric: str, method: str = "sum", title: str | None = None) -> DataFrame:
    value = aggregate_of(number(df, metric), method if method in ("sum", "mean", "max", "min", "count") else "sum")
    return df.agg(_tidy(value).alias("value")).select(F.lit(title or metric).alias("label"), "value")


def histogram(df: DataFrame, column: str, bins: Column | int | None = None) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins are kept.

    The bin count defaults to ``n // 10`` held between 5 and 20. Bin edges follow from
    one aggregate row, then rows are counted per bin with map-side combining.
    """
    x = number(df, column)
    count = F.col("n")
    wanted = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(count / 10))) if bins is None else bins
    wanted = F.lit(wanted) if isinstance(wanted, int) else wanted
    flat = F.col("lo") == F.col("hi")
    stats = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).where(count > 0).select(
        F.struct(wanted.cast("int").alias("bins"),
                 F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                 F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).alias("s"))
    edge = lambda i: F.col("s.lo") + i * (F.col("s.hi") - F.col("s.lo")) / F.col("s.bins")
    guess = F.least(F.floor((F.col("x") - F.col("s.lo")) * F.col("s.bins") / (F.col("s.hi") - F.col("s.lo"))), F.col("s.bins") - 1)
    # Rounding may put a value next to an edge into its neighbour's bin.
    exact = (F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1)
             .when((F.col("x") >= edge(F.col("g") + 1)) & (F.col("g") < F.col("s.bins") - 1), F.col("g") + 1)
             .otherwise(F.col("g")))
    counts = (
        df.select(x.alias("x"), stats.scalar().alias("s")).where(F.col("x").isNotNull())
        .withColumn("g", guess).groupBy(exact.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    )
    slots = stats.select("s", F.explode(F.sequence(F.lit(0), F.col("s.bins") - 1)).alias("bin"))
    return slots.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("range_start"), edge(F.col("bin") + 1).alias("range_end"),
        F.coalesce("c", F.lit(0)).alias("count"))


def missing_chart(profile: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Percentage of missing cells per column, columns with any, worst first."""
    return (profile.where(F.col("null_ratio") > 0).orderBy(F.desc("null_ratio"), "column").limit(limit)
            .select(F.col("column").alias("label"), F.round(F.col("null_ratio") * 100, 1).alias("value")))


def quality_chart(dimensions: DataFrame) -> DataFrame:
    return dimensions.where((F.col("status") == "assessed") & F.col("score").isNotNull()).select(
        F.col("dimension").alias("label"), F.round(F.col("score") * 100, 1).alias("value"))


def violations_chart(rule_results: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return (rule_results.where(F.col("error").isNull() & (F.col("fail_count") > 0))
            .orderBy(F.desc("fail_count"), "rule_key").limit(limit)
            .select(F.col("rule_key").alias("label"), F.col("fail_count").alias("value")))


def box_chart(df: DataFrame, metric: str, group: str | None = None) -> DataFrame:
    """Least, quartiles and largest value, per group when one is given."""
    keys = [group] if group else []
    kept = df.where(~missing(df, group)) if group else df
    values = quantiles(kept, [metric], [0.0, 0.25, 0.5, 0.75, 1.0], keys=keys)
    names = {0.0: "least", 0.25: "q25", 0.5: "median", 0.75: "q75", 1.0: "most"}
    return values.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])


def heatmap_chart(df: DataFrame, x: str, y: str, metric: str | None = None, method: str = "sum") -> DataFrame:
    value = number(df, metric) if metric else F.lit(1.0)
    return (df.where(~missing(df, x) & ~missing(df, y))
            .select(as_text(df, x).alias("x"), as_text(df, y).alias("y"), value.alias("_v"))
            .groupBy("x", "y").agg(_tidy(aggregate_of(F.col("_v"), method if metric else "count")).alias("value")))


def scatter_chart(df: DataFrame, x: str, y: str, order_by: list[str], points: int = SCATTER_POINTS) -> DataFrame:
    """A repeatable sample of point pairs: the rows with the smallest MD5 of their key, written with dashes between."""
    digest = F.md5(F.concat_ws("-", *[F.col(f"`{k}`").cast("string") for k in order_by]).cast("binary"))
    both = df.where(number(df, x).isNotNull() & number(df, y).isNotNull())
    return (both.orderBy(digest, *order_by).limit(points)
            .select(*order_by, number(df, x).alias("x"), number(df, y).alias("y")))
