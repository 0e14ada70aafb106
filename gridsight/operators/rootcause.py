"""Why a metric moved: summed drivers, correlated columns, tags; and KPIs found by role."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.parsing import missing, number, numeric_columns
from gridsight.functions.quantiles import quantile_values
from gridsight.operators.kpi import trend
from gridsight.plans.kpis import DRIVER_LABELS

# Name patterns for driver-like columns and metric qualifiers.
DRIVER_NAME = r"variance|driver|contribution|impact"
QUALIFIERS = r"\b(actual|budget|forecast|prior[_ ]year|ytd|ratio|rate|amount|pct|percent)\b"


def _ranked(rows: Column, keys: list[str], frame: DataFrame, digits: int) -> DataFrame:
    """Drivers as rows, largest absolute amount first, with shares of the absolute total."""
    kept = F.filter(rows, lambda r: r["amount"].isNotNull())
    order = F.array_sort(kept, lambda a, b: F.when(F.abs(a["amount"]) != F.abs(b["amount"]),
                                                   F.when(F.abs(a["amount"]) > F.abs(b["amount"]), -1).otherwise(1))
                         .otherwise(a["place"] - b["place"]))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, r: acc + F.abs(r["amount"]))
    explained = F.aggregate(kept, F.lit(0.0), lambda acc, r: acc + r["amount"])
    amount = F.col("d.amount")
    share = F.when(F.col("_total") > 0, F.abs(amount) / F.col("_total") * 100).otherwise(0.0)
    return frame.select(*keys, total.alias("_total"), explained.alias("_explained"), F.posexplode(order).alias("i", "d")).select(
        *keys, (F.col("i") + 1).alias("rank"), F.col("d.driver").alias("driver"), F.col("d.label").alias("label"),
        F.round(amount, digits).alias("amount"), F.round(share, 2).alias("contribution_pct"),
        F.when(amount > 0, "favorable").when(amount < 0, "unfavorable").otherwise("neutral").alias("direction"),
        F.round("_explained", 2).alias("explained_variance"))


def labelled_drivers(df: DataFrame, drivers: list[str] | None = None, labels: dict[str, str] = DRIVER_LABELS,
                     keys: list[str] = (), total_variance: float | None = None) -> DataFrame:
    """Sum every driver column and rank the drivers by size; one aggregate in all."""
    drivers = [d for d in (drivers or list(labels)) if d in df.columns]
    if not drivers:
        raise ValueError("no driver columns in the table")
    sums = [F.sum(number(df, d)).alias(f"_d{i}") for i, d in enumerate(drivers)]
    one = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(d).alias("driver"), F.lit(labels.get(d, d)).alias("label"),
                              F.col(f"_d{i}").alias("amount")) for i, d in enumerate(drivers)])
    total = F.lit(total_variance).cast("double")
    return _ranked(rows, list(keys), one, 2).withColumn(
        "unexplained_variance", F.round(total - F.col("explained_variance"), 2))


def _base_name(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(QUALIFIERS, "", name.replace("_", " ").lower())).strip()


def driver_candidates(df: DataFrame, metric: str, columns: list[str] | None = None) -> list[str]:
    """Numeric columns that may drive a metric: not its own budget or prior-year twin,
    and only driver-named ones where there are any."""
    pool = [c for c in (columns or numeric_columns(df)) if c != metric]
    base = _base_name(metric)
    if base:
        pool = [c for c in pool if _base_name(c) != base]
    return [c for c in pool if re.search(DRIVER_NAME, c, re.IGNORECASE)] or pool


def correlated_drivers(df: DataFrame, metric: str, columns: list[str] | None = None) -> DataFrame:
    """Correlation of each candidate with the metric over complete rows, with shares."""
    names = driver_candidates(df, metric, columns)
    if not names:
        raise ValueError("no candidate driver columns")
    complete = df.select(number(df, metric).alias("_y"), *[number(df, c).alias(f"_x{i}") for i, c in enumerate(names)]).dropna()
    one = complete.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(f"_x{i}", "_y").alias(f"_r{i}") for i in range(len(names))])
    value = lambda i: F.when(F.isnan(f"_r{i}"), F.lit(None)).otherwise(F.round(f"_r{i}", 4))
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("driver"),
                              F.lit(c.replace("_", " ").title()).alias("label"), value(i).alias("amount"))
                     for i, c in enumerate(names)])
    return _ranked(rows, [], one.where(F.col("_n") >= 3), 4).drop("explained_variance").withColumnRenamed("amount", "correlation")


def mode_tags(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """The most frequent tag per column, ties to the smallest; ``column, tag, copies``."""
    tags = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), F.col(f"`{c}`").cast("string")).alias("tag"))
                     for c in columns if c in df.columns])
    counts = (df.select(*keys, F.explode(tags).alias("t")).select(*keys, "t.*").where(F.col("tag").isNotNull())
              .groupBy(*keys, "column", "tag").agg(F.count("*").alias("copies")))
    best = F.min(F.struct((-F.col("copies")).alias("n"), F.col("tag").alias("tag"))).alias("b")
    return counts.groupBy(*keys, "column").agg(best).select(
        *keys, "column", F.col("b.tag").alias("tag"), (-F.col("b.n")).alias("copies"))


# Measure categories by semantic type, checked in this order.
MEASURES = [
    ("insurance_measure", r"claim|premium|insurance|policy|underwrit"),
    ("compensation_measure", r"salary|compensation|wage|bonus|payroll"),
    ("financial_measure", r"revenue|sales_amount|income|profit|expense|cost|budget_amount|actual_amount|forecast_amount|variance_amount"),
    ("payment_measure", r"monetary_amount|payment|transaction_amount|price|value"),
]
REVENUE_LIKE = r"revenue|sales_amount|income|profit"
EXPENSE_LIKE = r"expense|cost|budget_amount|actual_amount|forecast_amount|variance_amount"
OUTCOME_NAME = r"status|state|outcome|result_flag"
SUCCESS_VALUES = ["success", "approved", "completed", "paid", "settled", "won"]


def measure_category(semantic_type: str | None) -> str | None:
    for name, pattern in MEASURES:
        if semantic_type and re.search(pattern, semantic_type, re.IGNORECASE):
            return name
    return None


def discovered_kpis(df: DataFrame, roles: list[dict]) -> DataFrame:
    """KPIs that the columns' roles allow, computed: ``kpi, category, columns, measure, value``.

    ``roles`` is the described profile as plain rows in column order (``column``,
    ``semantic_type``, ``role``): one small row per column. All sums and counts are
    one aggregate; quartiles and the trend add a pass each where they apply.
    """
    metrics = [r for r in roles if r["role"] == "metric"]
    kind = {r["column"]: measure_category(r["semantic_type"]) for r in metrics}
    of = lambda category, pattern=r"": [r["column"] for r in metrics if kind[r["column"]] == category
                                        and re.search(pattern, r["semantic_type"] or "", re.IGNORECASE)]
    sum_of = lambda c: F.coalesce(F.sum(number(df, c)), F.lit(0.0))
    rows_all = F.count(F.lit(1)).cast("double")
    found: list[tuple[str, str, str, str, Column]] = []
    revenue, expense = of("financial_measure", REVENUE_LIKE), of("financial_measure", EXPENSE_LIKE)
    if revenue and expense:
        a, b = revenue[0], expense[0]
        found.append(("Profit Margin", "financial_measure", f"{a}, {b}", "ratio", F.try_divide(sum_of(a) - sum_of(b), sum_of(a))))
    payments, outcomes = of("payment_measure"), [r["column"] for r in roles if re.search(OUTCOME_NAME, r["column"], re.IGNORECASE)]
    if payments and outcomes:
        won = F.count_if(F.lower(F.col(f"`{outcomes[0]}`").cast("string")).isin(SUCCESS_VALUES))
        found.append(("Success Rate", "payment_measure", f"{payments[0]}, {outcomes[0]}", "rate", F.try_divide(won.cast("double"), rows_all)))
    salaries = of("compensation_measure")
    if salaries:
        for p, v in quantile_values(df, [salaries[0]], [0.25, 0.5, 0.75])[salaries[0]].items():
            found.append(("Salary Distribution", "compensation_measure", salaries[0], f"p{int(p * 100)}", F.lit(v)))
    claims = of("insurance_measure")
    if claims:
        found.append(("Claim Frequency", "insurance_measure", claims[0], "rate",
                      F.try_divide(F.count(number(df, claims[0])).cast("double"), rows_all)))
    actual, planned = of("financial_measure", "actual"), of("financial_measure", "budget|forecast")
    if actual and planned:
        a, b = actual[0], planned[0]
        found.append(("Variance vs Budget", "financial_measure", f"{a}, {b}", "ratio", F.try_divide(sum_of(a) - sum_of(b), sum_of(b))))
    other = [c for c, k in kind.items() if k is None]
    if len(other) >= 2:
        found.append(("Ratio Analysis", "financial_measure", f"{other[0]}, {other[1]}", "ratio", F.try_divide(sum_of(other[0]), sum_of(other[1]))))
    dates = [r["column"] for r in roles if r["role"] == "temporal_dimension"]
    out = None
    if found:
        one = df.agg(*[value.cast("double").alias(f"v{i}") for i, (*_, value) in enumerate(found)])
        out = one.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("kpi"), F.lit(k).alias("category"), F.lit(c).alias("columns"), F.lit(m).alias("measure"),
                     F.col(f"v{i}").alias("value")) for i, (n, k, c, m, _) in enumerate(found)])).alias("k")).select("k.*")
    if metrics and dates:
        name = metrics[0]["column"]
        moved = trend(df, dates[0], name).select(
            F.lit("Volume Trend").alias("kpi"), F.lit(kind[name] or "financial_measure").alias("category"),
            F.lit(f"{name}, {dates[0]}").alias("columns"), F.lit("change_pct").alias("measure"),
            F.col("overall_change_pct").alias("value"))
        out = out.unionByName(moved) if out is not None else moved
    if out is None:
        raise ValueError("the table's roles allow no KPI")
    return out
