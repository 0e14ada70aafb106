"""Series per key: building, describing and forecasting.

A series is summed to calendar periods first, so a key holds at most one row per
period and windows over it stay small however many rows it came from. All operators
take ``keys``; with none there is a single series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec, Window as W, functions as F

from gridsight.functions.parsing import moment, number

GRAINS = ("day", "week", "month", "quarter", "year")


def build_series(df: DataFrame, date_column: str, metric: str, keys: list[str] = (), grain: str = "day") -> DataFrame:
    """``keys…, ds, y``: the metric summed per period, rows without date or number dropped."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; one of {GRAINS}")
    date = moment(df, date_column).cast("date")
    ds = date if grain == "day" else F.trunc(date, grain)
    return (df.select(*keys, ds.alias("ds"), number(df, metric).alias("y"))
            .where(F.col("ds").isNotNull() & F.col("y").isNotNull())
            .groupBy(*keys, "ds").agg(F.sum("y").alias("y")))


def _order(keys: list[str]) -> WindowSpec:
    return (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("ds")


def _gaps(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.withColumn("gap", F.datediff("ds", F.lag("ds").over(_order(keys))))


def frequency(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Frequency by the median gap between dates; ``ME`` when there is only one date."""
    gap = F.median("gap")
    name = (F.when(gap <= 1.5, "D").when(gap <= 8, "W").when(gap <= 45, "ME").when(gap <= 135, "QE")
            .when(gap.isNull(), "ME").otherwise("YE"))
    return _gaps(series, list(keys)).groupBy(*keys).agg(F.count("*").alias("data_points"), gap.alias("median_gap_days"), name.alias("frequency"))


def describe_series(series: DataFrame, keys: list[str] = (), lag: int = 4) -> DataFrame:
    """Points, span, mean, population deviation, volatility and a seasonality hint."""
    lagged = series.withColumn("_before", F.lag("y", lag).over(_order(list(keys))))
    auto = F.corr("y", F.col("_before"))
    n, mean, std = F.count("*"), F.avg("y"), F.stddev_pop("y")
    return lagged.groupBy(*keys).agg(
        n.alias("data_points"), F.min("ds").alias("start_date"), F.max("ds").alias("end_date"),
        F.round(mean, 2).alias("mean"), F.round(std, 2).alias("std"), F.round(F.min("y"), 2).alias("min"),
        F.round(F.max("y"), 2).alias("max"), F.round(F.when(mean != 0, std / F.abs(mean)), 4).alias("volatility_ratio"),
        ((n >= 8) & F.coalesce(auto > 0.5, F.lit(False)) & ~F.isnan(F.coalesce(auto, F.lit(0.0)))).alias("seasonality_flag"),
    ).where(F.col("data_points") >= 2)


def _direction(first: Column, last: Column) -> Column:
    change = F.try_divide(last - first, F.abs(first)) * 100
    return F.when(change > 1, "increasing").when(change < -1, "decreasing").otherwise("flat")


series_direction = _direction


def series_tail(series: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Per key: ``n, last_ds, first_y, step`` and its newest values as ``back_1`` (the last) to ``back_{points}``."""
    newest = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.desc("ds"))
    ranked = series.withColumn("_i", F.row_number().over(newest)).withColumn("gap", F.datediff("ds", F.lead("ds").over(newest)))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("ds").alias("last_ds"), F.min_by("y", "ds").alias("first_y"), F.coalesce(F.median("gap"), F.lit(30.0)).alias("step"),
        *[F.max(F.when(F.col("_i") == i, F.col("y"))).alias(f"back_{i}") for i in range(1, points + 1)])


def _shape(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: points, last date, ends and the step between dates (30 days if unknown)."""
    return _gaps(series, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("ds").alias("last_ds"), F.min_by("y", "ds").alias("first_y"),
        F.max_by("y", "ds").alias("last_y"), F.coalesce(F.median("gap"), F.lit(30.0)).alias("step"))


def _future(per_key: DataFrame, keys: list[str], periods: int, yhat: Column, spread: Column, trend: Column,
            extra: list[Column] = ()) -> DataFrame:
    steps = per_key.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    ahead = F.date_add("last_ds", F.floor(F.col("step") * F.col("h")).cast("int"))
    return steps.select(*keys, "h", ahead.alias("ds"), F.round(yhat, 2).alias("yhat"), F.round(yhat - spread, 2).alias("yhat_lower"),
                        F.round(yhat + spread, 2).alias("yhat_upper"), trend.alias("trend_direction"), *extra)


def moving_average(series: DataFrame, keys: list[str] = (), periods: int = 6, window: int = 3) -> DataFrame:
    """Every future period is the mean of the last ``window`` points, ± their deviation."""
    keys = list(keys)
    newest = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.desc("ds"))
    tail = series.withColumn("_i", F.row_number().over(newest)).withColumn(
        "gap", F.datediff("ds", F.lead("ds").over(newest)))
    per_key = tail.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("ds").alias("last_ds"), F.coalesce(F.median("gap"), F.lit(30.0)).alias("step"),
        F.avg(F.when(F.col("_i") <= window, F.col("y"))).alias("mean"),
        F.stddev_pop(F.when(F.col("_i") <= window, F.col("y"))).alias("std")).where(F.col("n") >= 3)
    return _future(per_key, keys, periods, F.col("mean"), F.col("std"), F.lit("flat"))


def linear_trend(series: DataFrame, keys: list[str] = (), periods: int = 6) -> DataFrame:
    """Least squares on the period index, ± the population deviation of the residuals."""
    keys = list(keys)
    indexed = _gaps(series, keys).withColumn("x", F.row_number().over(_order(keys)) - 1)
    slope, n = F.regr_slope("y", "x"), F.count("*")
    squares = F.greatest(F.lit(0.0), F.regr_syy("y", "x") - slope * F.regr_sxy("y", "x"))
    per_key = indexed.groupBy(*keys).agg(
        n.alias("n"), F.max("ds").alias("last_ds"), F.coalesce(F.median("gap"), F.lit(30.0)).alias("step"),
        slope.alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.sqrt(squares / n).alias("std"),
        F.min_by("y", "ds").alias("first_y"), F.max_by("y", "ds").alias("last_y")).where(F.col("n") >= 5)
    yhat = F.col("slope") * (F.col("n") - 1 + F.col("h")) + F.col("intercept")
    return _future(per_key, keys, periods, yhat, F.col("std"), _direction(F.col("first_y"), F.col("last_y")),
                   [F.round("slope", 4).alias("trend_slope")])


def exponential_smoothing(series: DataFrame, keys: list[str] = (), periods: int = 6, alpha: float = 0.3) -> DataFrame:
    """The smoothed level as a flat forecast, ± the deviation of the one-step residuals.

    The recursion runs as an array fold inside the JVM over one key's periods.
    """
    keys = list(keys)
    start = F.struct(F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))

    def step(acc: Column, point: Column) -> Column:
        level = F.coalesce(alpha * point["y"] + (1 - alpha) * acc["level"], point["y"])
        miss = point["y"] - level
        return F.struct(level.alias("level"), (acc["s"] + miss).alias("s"), (acc["ss"] + miss * miss).alias("ss"))

    points = F.array_sort(F.collect_list(F.struct("ds", "y")))
    per_key = _gaps(series, keys).groupBy(*keys).agg(
        points.alias("p"), F.count("*").alias("n"), F.max("ds").alias("last_ds"),
        F.coalesce(F.median("gap"), F.lit(30.0)).alias("step"), F.min_by("y", "ds").alias("first_y")).where(F.col("n") >= 5)
    folded = per_key.withColumn("f", F.aggregate("p", start, step))
    mean = F.col("f.s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("f.ss") / F.col("n") - mean * mean))
    return _future(folded, keys, periods, F.col("f.level"), std, _direction(F.col("first_y"), F.col("f.level")))


def smoothed_series(series: DataFrame, keys: list[str] = (), alpha: float = 0.3) -> DataFrame:
    """``keys…, ds, y, smoothed``: the level of exponential smoothing after each point."""
    keys = list(keys)
    start = F.array().cast("array<struct<ds:date,y:double,level:double>>")

    def step(levels: Column, point: Column) -> Column:
        level = F.when(F.size(levels) == 0, point["y"]).otherwise(alpha * point["y"] + (1 - alpha) * F.element_at(F.concat(F.array(F.struct(
            point["ds"].alias("ds"), point["y"].alias("y"), point["y"].alias("level"))), levels), -1)["level"])
        return F.concat(levels, F.array(F.struct(point["ds"].alias("ds"), point["y"].alias("y"), level.alias("level"))))

    points = F.array_sort(F.collect_list(F.struct(F.col("ds").cast("date").alias("ds"), F.col("y").cast("double").alias("y"))))
    folded = series.groupBy(*keys).agg(points.alias("p")).select(*keys, F.explode(F.aggregate("p", start, step)).alias("s"))
    return folded.select(*keys, "s.ds", F.round("s.y", 2).alias("y"), F.round("s.level", 2).alias("smoothed"))


def autoregressive(series: DataFrame, keys: list[str] = (), periods: int = 6) -> DataFrame:
    """AR(1) by least squares on the previous value, forecast in closed form."""
    keys = list(keys)
    lagged = _gaps(series, keys).withColumn("_b", F.lag("y").over(_order(keys)))
    phi, n = F.regr_slope("y", "_b"), F.count("_b")
    squares = F.greatest(F.lit(0.0), F.regr_syy("y", "_b") - phi * F.regr_sxy("y", "_b"))
    per_key = lagged.groupBy(*keys).agg(
        n.alias("n"), F.max("ds").alias("last_ds"), F.coalesce(F.median("gap"), F.lit(30.0)).alias("step"),
        phi.alias("phi"), F.regr_intercept("y", "_b").alias("c"), F.sqrt(squares / n).alias("std"),
        F.min_by("y", "ds").alias("first_y"), F.max_by("y", "ds").alias("last_y")).where((F.col("n") >= 4) & F.col("phi").isNotNull())
    power = F.pow("phi", F.col("h"))
    drift = F.when(F.col("phi") == 1, F.col("c") * F.col("h")).otherwise(F.col("c") * (1 - power) / (1 - F.col("phi")))
    return _future(per_key, keys, periods, power * F.col("last_y") + drift, F.col("std"),
                   _direction(F.col("first_y"), F.col("last_y")), [F.round("phi", 4).alias("phi")])


def _seasonal_design(days: np.ndarray, start: float, span: float) -> np.ndarray:
    """Intercept, trend, yearly (order 10) and quarterly (order 5) waves."""
    columns = [np.ones_like(days), (days - start) / span]
    for period, order in ((365.25, 10), (91.25, 5)):
        for k in range(1, order + 1):
            columns += [np.sin(2 * np.pi * k * days / period), np.cos(2 * np.pi * k * days / period)]
    return np.column_stack(columns)


def seasonal_forecast(series: DataFrame, keys: list[str] = (), periods: int = 6, grain: str = "month",
                      ridge: float = 1.0, width: float = 1.2816) -> DataFrame:
    """Trend with yearly and quarterly waves, multiplicative where all values are positive.

    One ridge regression per key over its periods (at least six); the band is the
    residual deviation times ``width`` (80 %).
    """
    keys = list(keys)
    freq = {"day": "D", "week": "W-MON", "month": "MS", "quarter": "QS", "year": "YS"}[grain]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        columns = [*keys, "ds", "yhat", "yhat_lower", "yhat_upper", "trend_direction"]
        if len(pdf) < 6:
            return pd.DataFrame(columns=columns)
        dates = pd.to_datetime(pdf["ds"])
        days = dates.map(lambda d: d.toordinal()).to_numpy(dtype=float)
        span = max(days[-1] - days[0], 1.0)
        y = pdf["y"].to_numpy(dtype=float)
        logged = bool((y > 0).all())
        target = np.log(y) if logged else y
        design = _seasonal_design(days, days[0], span)
        penalty = np.eye(design.shape[1]) * ridge
        penalty[0, 0] = penalty[1, 1] = 1e-8
        beta = np.linalg.solve(design.T @ design + penalty, design.T @ target)
        spread = width * float(np.std(target - design @ beta))
        future = pd.date_range(dates.iloc[-1], periods=periods + 1, freq=freq)
        future = future[future > dates.iloc[-1]][:periods]
        ahead = np.array([d.toordinal() for d in future], dtype=float)
        mid = _seasonal_design(ahead, days[0], span) @ beta
        back = np.exp if logged else (lambda v: v)
        line = lambda d: back(beta[0] + beta[1] * (d - days[0]) / span)
        first, last = line(days[0]), line(ahead[-1]) if len(ahead) else line(days[-1])
        moved = "increasing" if last > first * 1.01 else "decreasing" if last < first * 0.99 else "flat"
        out = pd.DataFrame({"ds": future.date, "yhat": back(mid), "yhat_lower": back(mid - spread),
                            "yhat_upper": back(mid + spread), "trend_direction": moved})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[columns].round({"yhat": 2, "yhat_lower": 2, "yhat_upper": 2})

    types = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "ds date", "yhat double", "yhat_lower double",
                        "yhat_upper double", "trend_direction string"])
    grouped = series.groupBy(*keys) if keys else series.groupBy(F.lit(0).alias("_all"))
    return grouped.applyInPandas(fit, schema)


def lag_features(series: DataFrame, keys: list[str] = (), lags: int = 3) -> DataFrame:
    """``lag_1 … lag_n`` and the calendar month as columns for a feature-based forecast."""
    out = series.withColumns({f"lag_{i}": F.lag("y", i).over(_order(list(keys))) for i in range(1, lags + 1)})
    return out.withColumn("month_of_year", F.month("ds").cast("double"))
