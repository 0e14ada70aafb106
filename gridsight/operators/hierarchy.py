"""Hierarchies as functional dependencies, and drill-down cubes along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridsight.functions.parsing import as_text, missing, number

ACCEPTED, WARNING, MIN_COVERAGE = 0.98, 0.90, 0.90
MIN_GROUP = 5


def _edge_values(df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """Distinct ``edge, child, parent`` triples with a child, for all edges in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("edge"),
                 F.when(~missing(df, parent), as_text(df, parent)).alias("parent"),
                 F.when(~missing(df, child), as_text(df, child)).alias("child"))
        for i, (parent, child) in enumerate(edges)])
    return (
        df.select(F.explode(pairs).alias("e")).select("e.*").where(F.col("child").isNotNull())
        .groupBy("edge", "child", "parent").agg(F.count("*").alias("copies"))
    )


def _status(consistency: Column, coverage: Column) -> Column:
    return (F.when(coverage < MIN_COVERAGE, "rejected").when(consistency >= ACCEPTED, "accepted")
            .when(consistency >= WARNING, "retained_with_warning").otherwise("rejected"))


def dependency_edges(df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """How well each child column determines its parent column.

    Children without a value are ignored; children whose parent is missing lower the
    coverage but are no violation.
    """
    per_child = _edge_values(df, edges).groupBy("edge", "child").agg(F.count("parent").alias("parents"))
    counted = per_child.groupBy("edge").agg(
        F.count("*").alias("children"), F.count_if(F.col("parents") > 0).alias("mapped"),
        F.count_if(F.col("parents") > 1).alias("violating"))
    listed = df.sparkSession.createDataFrame(
        [(i, p, c) for i, (p, c) in enumerate(edges)], "edge int, parent_column string, child_column string")
    n = F.coalesce("children", F.lit(0))
    consistency = F.when(n > 0, 1 - F.col("violating") / n).otherwise(1.0)
    coverage = F.when(n > 0, F.col("mapped") / n).otherwise(0.0)
    return listed.join(counted, "edge", "left").select(
        "edge", "parent_column", "child_column", n.alias("distinct_child_count"),
        F.coalesce("mapped", F.lit(0)).alias("mapped_child_count"),
        F.coalesce("violating", F.lit(0)).alias("violating_child_count"),
        consistency.alias("fd_consistency"), coverage.alias("mapping_coverage"),
        (consistency * coverage).alias("edge_confidence"), _status(consistency, coverage).alias("status"))


def dependency_conflicts(df: DataFrame, parent: str, child: str, children: int = 5, parents: int = 5) -> DataFrame:
    """The first children, by value, with more than one parent, and their first parents."""
    values = _edge_values(df, [(parent, child)]).where(F.col("parent").isNotNull())
    worst = (values.groupBy("child").agg(F.count("parent").alias("parent_count"))
             .where(F.col("parent_count") > 1).orderBy("child").limit(children))
    order = W.partitionBy("child").orderBy("parent")
    few = (values.join(worst, "child").withColumn("rank", F.row_number().over(order))
           .where(F.col("rank") <= parents))
    return few.groupBy("child", "parent_count").agg(
        F.array_sort(F.collect_list("parent")).alias("parent_values")).withColumnRenamed("child", "child_value")


def _chain_runs(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Every run of neighbouring valid edges of every candidate chain."""
    edges = sorted({(a, b) for levels in candidates.values() for a, b in zip(levels, levels[1:])
                    if a in df.columns and b in df.columns})
    places = [(name, order, i, a, b) for order, (name, levels) in enumerate(candidates.items())
              for i, (a, b) in enumerate(zip(levels, levels[1:]))]
    spots = df.sparkSession.createDataFrame(
        places, "chain string, chain_order int, spot int, parent_column string, child_column string")
    checked = dependency_edges(df, edges).drop("edge") if edges else None
    if checked is None:
        checked = df.sparkSession.createDataFrame([], "parent_column string, child_column string, edge_confidence double, status string")
    joined = spots.join(checked, ["parent_column", "child_column"], "left").withColumn(
        "rejected", F.coalesce(F.col("status") == "rejected", F.lit(True)))
    # A chain has a handful of edges.
    before = W.partitionBy("chain").orderBy("spot").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        joined.withColumn("run", F.sum(F.col("rejected").cast("int")).over(before))
        .where(~F.col("rejected")).groupBy("chain", "chain_order", "run").agg(
            F.min("spot").alias("first_spot"), F.count("*").alias("edges"),
            F.avg("edge_confidence").alias("average_confidence"),
            F.bool_or(F.col("status") == "retained_with_warning").alias("warned"))
    )


def hierarchy_chains(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """The longest valid run of each candidate chain; ``unresolved`` where there is none."""
    runs = _chain_runs(df, candidates)
    order = W.partitionBy("chain").orderBy(F.desc("edges"), F.asc("first_spot"))
    best = runs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1)
    listed = df.sparkSession.createDataFrame(
        [(i, name, levels) for i, (name, levels) in enumerate(candidates.items())],
        "chain_order int, chain string, levels array<string>")
    return listed.join(best.drop("chain_order"), "chain", "left").select(
        "chain", "chain_order",
        F.when(F.col("edges").isNull(), F.array().cast("array<string>"))
        .otherwise(F.expr("slice(levels, first_spot + 1, CAST(edges + 1 AS INT))")).alias("level_columns"),
        F.coalesce(F.col("average_confidence"), F.lit(0.0)).alias("average_confidence"),
        F.when(F.col("edges").isNull(), "unresolved").when(F.col("warned"), "partial").otherwise("accepted").alias("status"))


def best_hierarchy(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """The best candidate: most levels, then highest confidence, then listed first."""
    return hierarchy_chains(df, candidates).orderBy(
        F.desc(F.size("level_columns")), F.desc("average_confidence"), "chain_order").limit(1).drop("chain_order")


def drill_down_cubes(df: DataFrame, levels: list[str], metric: str, min_group: int = MIN_GROUP,
                     max_labels: int | None = None) -> DataFrame:
    """Sum and count of a metric at every level below every parent path.

    The table is grouped once at the finest level; the rollup expands those groups, not
    the rows. Groups with fewer than ``min_group`` metric values and paths with fewer
    than ``min_group`` rows are suppressed. ``max_labels`` keeps the first labels per path.
    """
    keys = [f"_l{i}" for i in range(len(levels))]
    text = [F.when(~missing(df, c), as_text(df, c)).alias(k) for c, k in zip(levels, keys)]
    fine = df.select(*text, number(df, metric).alias("_m")).groupBy(*keys).agg(
        F.sum("_m").alias("s"), F.count("_m").alias("c"), F.count("*").alias("r"))
    rolled = fine.rollup(*keys).agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.grouping_id().alias("g"))
    out = []
    for depth, key in enumerate(keys):
        out.append((F.col("g") == (1 << (len(keys) - depth - 1)) - 1, depth, key))
    pick = lambda values: reduce(lambda rest, v: F.when(v[0], v[1]).otherwise(rest), values[1:], F.when(*values[0]))
    path = pick([(t, F.map_from_arrays(F.array(*[F.lit(x) for x in levels[:d]]).cast("array<string>"),
                                       F.array(*keys[:d]).cast("array<string>"))) for t, d, _ in out])
    flat = rolled.where(F.col("g") < (1 << len(keys)) - 1).select(
        pick([(t, F.lit(d)) for t, d, _ in out]).alias("level_depth"),
        pick([(t, F.lit(levels[d])) for t, d, _ in out]).alias("level_column"),
        pick([(t, F.col(k)) for t, _, k in out]).alias("label"),
        path.alias("path"), F.to_json(path).alias("_path"), "s", "c", "r")
    # A path's rows include the children without a label, so they are summed first.
    totals = flat.groupBy("level_depth", "_path").agg(F.sum("r").alias("record_count"))
    whole = F.size(F.filter(F.map_values("path"), lambda v: v.isNull())) == 0
    cubes = (
        flat.join(totals, ["level_depth", "_path"])
        .where(whole & F.col("label").isNotNull() & (F.col("c") >= min_group) & (F.col("record_count") >= min_group))
    )
    if max_labels:
        order = W.partitionBy("level_depth", "_path").orderBy("label")
        cubes = cubes.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_labels)
    return cubes.select("level_depth", "level_column", "path", "label",
                        F.round(F.coalesce("s", F.lit(0.0)), 2).alias("value"), F.col("c").alias("count"),
                        "record_count", F.lit(metric).alias("metric"))


class DrillDownError(ValueError):
    """The path does not fit the hierarchy."""


def drill_down(cubes: DataFrame, levels: list[str], path: dict[str, str]) -> DataFrame:
    """The cube rows one level below a selected path."""
    for name in path:
        if name not in levels:
            raise DrillDownError(f"column {name!r} is not part of the hierarchy")
    if len(path) >= len(levels):
        raise DrillDownError("already at the deepest level")
    after = levels[len(path) + 1] if len(path) + 1 < len(levels) else None
    out = cubes.where(F.col("level_column") == levels[len(path)])
    for name, value in path.items():
        out = out.where(F.try_element_at("path", F.lit(name)) == value)
    return out.withColumn("next_level", F.lit(after).cast("string"))


def temporal_levels(df: DataFrame, date_column: str) -> DataFrame:
    """Adds ``fiscal_year``, ``quarter`` and ``month`` for a drill path over time."""
    date = F.col(f"`{date_column}`").cast("date")
    return df.withColumns({
        "fiscal_year": F.year(date).cast("string"),
        "quarter": F.concat(F.year(date), F.lit("-Q"), F.quarter(date)),
        "month": F.date_format(date, "yyyy-MM"),
    })


# The configured drill paths.
DRILL_PATHS = {
    "geographic": ["region", "country_name", "insurer_legal_entity", "insurance_regulator"],
    "temporal": ["fiscal_year", "quarter", "month", "reporting_date"],
    "business": ["insurance_segment", "business_unit", "underwriting_department", "line_of_business",
                 "product_category", "product_name"],
    "customer": ["policyholder_segment", "customer_type", "industry_sector"],
    "distribution": ["distribution_channel"],
    "risk": ["underwriting_risk_band", "coverage_type", "policy_term_type"],
    "reinsurance": ["reinsurance_treaty_type"],
}
