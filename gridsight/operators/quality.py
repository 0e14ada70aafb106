"""Ten quality dimensions and their weighted score, from profile and rule rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.parsing import missing, moment

# Dimension weights and the parts of semantic quality.
WEIGHTS = {
    "completeness": 0.20, "uniqueness": 0.15, "validity": 0.15, "conformity": 0.10, "consistency": 0.15,
    "business_rule_compliance": 0.10, "timeliness": 0.05, "integrity": 0.03, "accuracy": 0.02, "semantic_quality": 0.05,
}
SEMANTIC_WEIGHTS = {
    "schema_intelligence_confidence": 0.30, "column_classification_confidence": 0.25,
    "secondary_domain_confidence": 0.25, "hierarchy_confidence": 0.20,
}
RULE_DIMENSIONS = {
    "validity": ["numeric_range", "allowed_values", "date_range"],
    "conformity": ["regex_match"],
    "consistency": ["column_comparison", "cross_field_equality", "cross_field_inequality"],
}


def _dimension(name: str, assessed: Column, checked: Column, failed: Column, score: Column | None = None) -> Column:
    score = F.when(checked > 0, 1 - failed / checked).otherwise(1.0) if score is None else score
    return F.struct(
        F.lit(name).alias("dimension"), F.when(assessed, score).alias("score"),
        F.when(assessed, "assessed").otherwise("not_assessable").alias("status"),
        F.when(assessed, checked).otherwise(0).cast("bigint").alias("assessed_count"),
        F.when(assessed, failed).otherwise(0).cast("bigint").alias("violation_count"))


def quality_dimensions(profile: DataFrame, rule_results: DataFrame, mandatory: list[str] | None = None,
                       unique: list[str] | None = None, confidences: dict[str, float | None] | None = None,
                       timeliness: float | None = None, integrity: float | None = None) -> DataFrame:
    """One row per dimension; a dimension without evidence is not assessable, never zero.

    ``timeliness`` and ``integrity`` take scores from ``freshness`` and
    ``reference_integrity`` where a caller has an SLA or a reference table.
    """
    zero = F.lit(0)
    total = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), zero)
    listed = lambda names: F.col("column").isin(names or []) | F.col("normalized_key").isin(names or [])
    by_column = profile.agg(F.struct(
        F.count_if(listed(mandatory)).alias("m"), total("row_count", listed(mandatory)).alias("m_cells"),
        total("null_count", listed(mandatory)).alias("m_nulls"),
        F.count_if(listed(unique)).alias("u"), total("row_count", listed(unique)).alias("u_cells"),
        total("duplicate_count", listed(unique)).alias("u_dups")).alias("p"))
    clean = F.col("error").isNull()
    counters = []
    for name, types in RULE_DIMENSIONS.items():
        mine = clean & F.col("rule_type").isin(types)
        counters += [F.count_if(mine).alias(f"{name}_n"), total("records_checked", mine).alias(f"{name}_c"),
                     total("fail_count", mine).alias(f"{name}_f")]
    used = clean & (F.col("records_checked") > 0)
    counters += [F.count_if(used).alias("all_n"), total("records_checked", used).alias("all_c"), total("fail_count", used).alias("all_f")]
    one = rule_results.agg(*counters).select("*", by_column.scalar().alias("p"))

    known = {k: v for k, v in (confidences or {}).items() if v is not None}
    weight = sum(SEMANTIC_WEIGHTS[k] for k in known)
    semantic = sum(SEMANTIC_WEIGHTS[k] * v for k, v in known.items()) / weight if weight else None
    given = lambda score: (F.lit(score is not None), F.lit(0 if score is None else 1), zero, F.lit(score).cast("double"))
    c = F.col
    rows = [
        _dimension("completeness", c("p.m") > 0, c("p.m_cells"), c("p.m_nulls")),
        _dimension("uniqueness", c("p.u") > 0, c("p.u_cells"), c("p.u_dups")),
        *[_dimension(n, c(f"{n}_n") > 0, c(f"{n}_c"), c(f"{n}_f")) for n in RULE_DIMENSIONS],
        _dimension("business_rule_compliance", c("all_n") > 0, c("all_c"), c("all_f")),
        _dimension("timeliness", *given(timeliness)),
        _dimension("integrity", *given(integrity)),
        _dimension("accuracy", *given(None)),
        _dimension("semantic_quality", F.lit(bool(weight)), F.lit(len(known)), zero, F.lit(semantic).cast("double")),
    ]
    return one.select(F.explode(F.array(*rows)).alias("d")).select("d.*")


def overall_quality(dimensions: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted mean over assessed dimensions only."""
    weight = F.create_map(*[F.lit(x) for item in weights.items() for x in item])[F.col("dimension")]
    used = F.when(F.col("score").isNotNull() & (F.col("status") == "assessed"), weight)
    score = F.try_divide(F.sum(used * F.col("score")), F.sum(used))
    return dimensions.agg(
        F.round(score, 4).alias("overall_score"), F.round(score * 100, 2).alias("display_score"),
        F.count(used).alias("assessed_dimensions"), F.count_if(used.isNull()).alias("excluded_dimensions"))


def reference_integrity(df: DataFrame, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """One row: how many non-null values have no partner in a reference table.

    Values are counted before the join, so a hot key is one row and the join cannot
    skew; the reference is reduced to its distinct keys.
    """
    keys = df.where(~missing(df, column)).groupBy(F.col(f"`{column}`").alias("k")).agg(F.count("*").alias("copies"))
    known = reference.select(F.col(f"`{reference_column}`").alias("k")).where(F.col("k").isNotNull()).distinct().withColumn("known", F.lit(True))
    joined = keys.join(known, "k", "left")
    checked = F.coalesce(F.sum("copies"), F.lit(0))
    failed = F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("copies"))), F.lit(0))
    return joined.agg(checked.alias("records_checked"), failed.alias("fail_count"),
                      F.count_if(F.col("known").isNull()).alias("missing_keys")).select(
        "*", F.when(F.col("records_checked") > 0, 1 - F.col("fail_count") / F.col("records_checked")).otherwise(1.0).alias("score"))


def freshness(df: DataFrame, column: str, as_of: str, max_age_days: float) -> DataFrame:
    """One row: newest moment, its age at ``as_of`` and whether it meets the SLA."""
    newest = F.max(moment(df, column))
    # Wall-clock times: the difference must not depend on the session's time zone.
    passed = (F.lit(as_of).cast("timestamp_ntz") - F.col("newest")).cast("interval second")
    age = passed.cast("decimal(20,6)").cast("double") / 86_400
    return df.agg(newest.alias("newest")).select(
        "newest", age.alias("age_days"), F.when(age <= max_age_days, 1.0).otherwise(0.0).alias("score"))
