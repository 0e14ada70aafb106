"""KPI arithmetic: aggregates, variance, growth, trend, ranking, contribution."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridsight.functions.parsing import missing, moment, number
from gridsight.functions.quantiles import quantiles
from gridsight.functions.scale import row_numbers

METHODS = ("sum", "mean", "median", "min", "max", "count")


def _method(value: Column, method: str) -> Column:
    made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    if method not in made:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    return made[method](value).cast("double")


def aggregate(df: DataFrame, column: str, method: str = "sum", keys: list[str] = ()) -> DataFrame:
    """``keys…, value``; a group without numbers gives 0."""
    if method == "median":
        return quantiles(df, [column], [0.5], keys=list(keys)).select(*keys, "value")
    value = F.coalesce(_method(number(df, column), method), F.lit(0.0)).alias("value")
    return df.groupBy(*keys).agg(value) if keys else df.agg(value)


def variance_columns(actual: Column, reference: Column, higher_is_better: bool | Column = True) -> list[Column]:
    """``variance_amount``, ``variance_pct`` (null against 0) and ``direction``."""
    amount = actual - reference
    better = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better
    pct = F.when(reference != 0, amount / F.abs(reference) * 100)
    direction = (F.when(amount == 0, "neutral").when(amount.isNull(), F.lit(None).cast("string"))
                 .when((amount > 0) == better, "favorable").otherwise("unfavorable"))
    return [F.round(amount, 2).alias("variance_amount"), F.round(pct, 2).alias("variance_pct"), direction.alias("direction")]


def variance(df: DataFrame, actual: str, reference: str, keys: list[str] = (), method: str = "sum",
             higher_is_better: bool = True) -> DataFrame:
    """Actual against a reference column, per group."""
    both = df.groupBy(*keys).agg(
        F.coalesce(_method(number(df, actual), method), F.lit(0.0)).alias("_a"),
        F.coalesce(_method(number(df, reference), method), F.lit(0.0)).alias("_r"))
    return both.select(*keys, F.round("_a", 2).alias("actual"), F.round("_r", 2).alias("reference"),
                       *variance_columns(F.col("_a"), F.col("_r"), higher_is_better))


def growth(df: DataFrame, period: str | Column, value: str, keys: list[str] = (), method: str = "sum",
           lag: int = 1) -> DataFrame:
    """Percentage change of each period on the one ``lag`` periods before.

    Rows are summed per period first; the window runs over those few rows.
    """
    when = F.col(f"`{period}`") if isinstance(period, str) else period
    per_period = (df.select(*keys, when.alias("period"), number(df, value).alias("_v"))
                  .where(F.col("period").isNotNull()).groupBy(*keys, "period")
                  .agg(F.coalesce(_method(F.col("_v"), method), F.lit(0.0)).alias("current")))
    order = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("period")
    before = F.lag("current", lag).over(order)
    return per_period.withColumn("previous", before).select(
        *keys, "period", F.round("current", 2).alias("current"), F.round("previous", 2).alias("previous"),
        F.round(F.when(F.col("previous") != 0, (F.col("current") - F.col("previous")) / F.abs("previous") * 100), 2).alias("growth_pct"))


def trend(df: DataFrame, date_column: str, value: str, keys: list[str] = ()) -> DataFrame:
    """First against last point of the per-date sums: change, direction, points."""
    per_date = (df.select(*keys, moment(df, date_column).alias("_d"), number(df, value).alias("_v"))
                .where(F.col("_d").isNotNull() & F.col("_v").isNotNull())
                .groupBy(*keys, "_d").agg(F.sum("_v").alias("_v")))
    ends = per_date.groupBy(*keys).agg(
        F.min_by("_v", "_d").alias("first"), F.max_by("_v", "_d").alias("last"), F.count("*").alias("data_points"))
    pct = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100)
    return ends.where(F.col("data_points") >= 2).select(
        *keys, F.round("first", 2).alias("first_value"), F.round("last", 2).alias("last_value"),
        F.round(pct, 2).alias("overall_change_pct"),
        F.when(pct > 1, "increasing").when(pct < -1, "decreasing").otherwise("flat").alias("direction"), "data_points")


def rank_rows(df: DataFrame, value: str, label: str, top: int = 5, ascending: bool = False) -> DataFrame:
    """The ``top`` rows by value with their rank; a top-k, so only k rows are gathered."""
    clean = df.select(F.col(f"`{label}`").alias("label"), number(df, value).alias("value")).where(
        F.col("label").isNotNull() & F.col("value").isNotNull())
    order = [F.asc("value") if ascending else F.desc("value"), F.asc("label")]
    best = clean.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


def contribution(df: DataFrame, value: str, label: str) -> DataFrame:
    """Each label's share of the total absolute value, in per cent."""
    groups = (df.where(~missing(df, label)).select(F.col(f"`{label}`").alias("label"), number(df, value).alias("_v"))
              .groupBy("label").agg(F.sum("_v").alias("_v")).where(F.col("_v").isNotNull()))
    total = groups.agg(F.sum(F.abs("_v"))).scalar()
    return groups.select("label", F.round("_v", 2).alias("value"),
                         F.round(F.when(total == 0, 0.0).otherwise(F.abs("_v") / total * 100), 2).alias("contribution_pct"))


def compare_groups(df: DataFrame, value: str, group: str, method: str = "sum") -> DataFrame:
    """A metric per group, ranked, with the extremes marked."""
    clean = df.select(F.col(f"`{group}`").alias("label"), number(df, value).alias("_v")).where(
        F.col("label").isNotNull() & F.col("_v").isNotNull())
    if method == "median":
        groups = quantiles(clean, ["_v"], [0.5], keys=["label"]).select("label", F.col("value").alias("_v"))
    else:
        groups = clean.groupBy("label").agg(_method(F.col("_v"), method).alias("_v"))
    ranked = row_numbers(groups, [F.desc("_v"), F.asc("label")])
    count = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.select("label", F.round("_v", 2).alias("value"), "rank", count.alias("group_count")).withColumn(
        "extreme", F.when(F.col("rank") == 1, "highest").when(F.col("rank") == F.col("group_count"), "lowest"))


def kpi_method(kpi: dict[str, Any]) -> str:
    """Ratios and rates are averaged, amounts summed."""
    return "mean" if kpi.get("unit") in ("%", "ratio", "rate") or kpi.get("category") == "ratio" else "sum"


def kpi_summary(df: DataFrame, kpis: list[dict[str, Any]], keys: list[str] = (), prior_year: bool = False) -> DataFrame:
    """Actual, budget and (optionally) prior year of every KPI whose columns exist.

    All KPIs are one aggregate; the rows are made from its single row per group.
    """
    present = [k for k in kpis if k["actual_column"] in df.columns]
    if not present:
        raise ValueError(f"none of the KPI columns exist: {[k['actual_column'] for k in kpis]}")
    aggs, rows = [], []
    for i, kpi in enumerate(present):
        method, found = kpi_method(kpi), {}
        for part in ("actual", "budget") + (("prior_year",) if prior_year else ()):
            name = kpi.get(f"{part}_column")
            if name and name in df.columns:
                aggs.append(F.coalesce(_method(number(df, name), method), F.lit(0.0)).alias(f"{part}_{i}"))
                found[part] = F.col(f"{part}_{i}")
        none = F.lit(None).cast("double")
        actual, budget, prior = found["actual"], found.get("budget", none), found.get("prior_year", none)
        better = kpi.get("higher_is_better", True)
        fields = [F.lit(kpi["key"]).alias("kpi"), F.lit(kpi["unit"]).alias("unit"), F.round(actual, 2).alias("actual"),
                  F.round(budget, 2).alias("budget"), *variance_columns(actual, budget, better)]
        if prior_year:
            amount, pct, _ = variance_columns(actual, prior, better)
            fields += [F.round(prior, 2).alias("prior_year"), amount.alias("variance_vs_prior_year_amount"),
                       pct.alias("variance_vs_prior_year_pct")]
        rows.append(F.struct(*fields))
    one = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return one.select(*keys, F.explode(F.array(*rows)).alias("k")).select(*keys, "k.*")


def kpi_ratios(df: DataFrame, formulas: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """Formulas over sums, in dependency order: a later one may use an earlier one.

    Each formula is SQL over input columns (summed per group) or earlier results;
    formulas whose names are not all available are left out.
    """
    from gridsight.functions.conditions import _TOKEN

    used = {t for text in formulas.values() for t in _TOKEN.findall(text) if t.isidentifier()}
    inputs = [c for c in df.columns if c in used and c not in keys]
    sums = [F.sum(number(df, c)).alias(c) for c in inputs]
    out = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
    made = []
    for name, text in formulas.items():
        needs = {t for t in _TOKEN.findall(text) if t.isidentifier() and t.lower() not in ("try_divide", "abs")}
        if needs <= set(out.columns):
            out = out.withColumn(name, F.expr(text).cast("double"))
            made.append(name)
    return out.select(*keys, *made)
