"""Readiness of a table for analytics, model training and question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FEATURE_TARGET = 10.0
# How much a recommended feature counts.
USEFULNESS = {"high": 1.0, "medium": 0.6, "low": 0.25}


def _status(score: Column) -> Column:
    return F.when(score >= 80, "ready").when(score >= 60, "partially_ready").otherwise("not_ready")


def readiness(described: DataFrame, dimensions: DataFrame, description_coverage: float = 0.0,
              features: DataFrame | None = None, approach_confidence: float | None = None) -> DataFrame:
    """Four rows (analytics, ml, llm, overall): score, status, dataset and task parts.

    ``described`` is the profile with roles, ``dimensions`` the quality rows.
    ``features`` is a feature recommendation (``column, usefulness``): with it, feature
    coverage counts recommended features, without it every non-identifier column.
    """
    c, lit = F.col, F.lit
    score_of = lambda d: F.max(F.when((c("dimension") == d) & (c("status") == "assessed"), c("score")))
    quality = dimensions.agg(F.struct(*[score_of(d).alias(d) for d in (
        "completeness", "validity", "consistency", "uniqueness", "semantic_quality")]).alias("q"))
    grain = c("is_identifier")
    shape = described.agg(
        F.count(lit(1)).alias("n"), F.coalesce(F.max("row_count"), lit(0)).alias("rows"),
        F.count_if(c("role") == "metric").alias("metrics"), F.count_if(c("role") == "dimension").alias("dimensions"),
        F.count_if(c("role") == "temporal_dimension").alias("temporal"), F.count_if(grain).alias("grain"),
        F.count_if(~grain & (c("cardinality_ratio") > 0.9)).alias("wide"),
        F.coalesce(F.avg("null_ratio"), lit(0.0)).alias("nulls"),
        F.coalesce(F.avg((F.size("representative_values") > 0).cast("double")), lit(0.0)).alias("sampled"))
    one = shape.select("*", quality.scalar().alias("q")).select("*", "q.*")
    if features is not None:
        useful = F.coalesce(F.create_map(*[lit(x) for i in USEFULNESS.items() for x in i])[c("usefulness")], lit(0.5))
        grains = described.where(grain).select("column")
        leaked = features.join(grains, "column", "left_semi").agg(F.count(lit(1)))
        one = one.select("*", features.agg(F.coalesce(F.sum(useful), lit(0.0))).scalar().alias("useful"),
                         leaked.scalar().alias("leaked"))

    part = lambda name, points: F.coalesce(c(name) * points, lit(0.0))
    most = lambda name, points: F.when(c(name).isNotNull(), float(points)).otherwise(0.0)
    analytics = F.least(lit(100.0), (
        part("completeness", 20) + part("validity", 15) + part("consistency", 15)
        + F.when(c("metrics") >= 2, 15).when(c("metrics") >= 1, 8).otherwise(0)
        + F.when(c("dimensions") >= 3, 15).when(c("dimensions") >= 1, 8).otherwise(0)
        + F.when(c("grain") > 0, 10).otherwise(0) + F.when(c("temporal") > 0, 10).otherwise(0)).cast("double"))

    rows = F.when(c("rows") >= 10000, 15.0).when(c("rows") >= 1000, 10.0).when(c("rows") >= 100, 5.0).otherwise(0.0)
    health = F.when(c("n") <= c("grain"), 0.0).when(c("wide") == 0, 10.0).otherwise(5.0)
    health_most = F.when(c("n") <= c("grain"), 0.0).otherwise(10.0)
    structural = part("completeness", 20) + part("consistency", 15) + rows + health + part("uniqueness", 10)
    structural_most = most("completeness", 20) + most("consistency", 15) + 15.0 + health_most + most("uniqueness", 10)
    none = lit(None).cast("double")
    clamp = lambda v: F.greatest(lit(0.0), F.least(lit(100.0), v))
    if features is not None:
        coverage = F.least(lit(1.0), c("useful") / FEATURE_TARGET) * 15
        penalty = F.when(F.try_divide(c("leaked").cast("double"), c("grain").cast("double")) > 0.3, 10.0).otherwise(0.0)
        ml = clamp(structural + coverage - penalty)
        ml_dataset, ml_task = clamp(structural / structural_most * 100), clamp((coverage - penalty) / 15 * 100)
    else:
        coverage = (c("n") - c("grain")) / F.greatest(c("n"), lit(1)) * 15
        ml = clamp(structural + coverage)
        ml_dataset, ml_task = clamp((structural + coverage) / (structural_most + 15) * 100), none

    described_points = 25.0 if description_coverage >= 0.8 else 15.0 if description_coverage >= 0.5 else description_coverage * 25
    llm_dataset = clamp(lit(described_points) + part("semantic_quality", 20) + (1 - c("nulls")) * 15 + 15
                        + c("sampled") * 10 + min(15.0, description_coverage * 15))
    if approach_confidence is not None:
        llm = F.least(lit(100.0), llm_dataset + min(10.0, approach_confidence * 10))
        llm_task = clamp(lit(approach_confidence * 100))
    else:
        llm, llm_task = llm_dataset, none

    mean = lambda values: F.aggregate(F.array_compact(F.array(*values)), lit(0.0), lambda a, v: a + v) / F.nullif(
        F.size(F.array_compact(F.array(*values))), lit(0))
    row = lambda name, score, dataset, task: F.struct(
        lit(name).alias("assessment"), F.round(score, 2).alias("score"), _status(score).alias("status"),
        F.round(dataset, 2).alias("dataset_score"), F.round(task, 2).alias("task_score"))
    table = F.array(
        row("analytics", analytics, analytics, none), row("ml", ml, ml_dataset, ml_task),
        row("llm", llm, llm_dataset, llm_task),
        row("overall", (analytics + ml + llm) / 3, mean([analytics, ml_dataset, llm_dataset]), mean([ml_task, llm_task])))
    return one.select(F.explode(table).alias("r")).select("r.*")
