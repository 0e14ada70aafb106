"""Result tables: one per kind of result, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The kinds of result a run leaves behind.
RESULT_TABLES = [
    "profile_runs", "dataset_profiles", "column_profiles", "column_classifications",
    "hierarchies", "hierarchy_edges", "quality_results", "readiness_results",
    "chart_results", "drill_down_cubes", "feature_recommendations", "rule_evaluations",
]


def write_result(df: DataFrame, root: str, table: str, run_id: str) -> None:
    """Write one result of one run; writing the same run again replaces it."""
    if table not in RESULT_TABLES:
        raise ValueError(f"unknown result table {table!r}; one of {RESULT_TABLES}")
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").parquet(f"{root.rstrip('/')}/{table}")
    )


def read_result(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """Read a result table, pruned to one run when ``run_id`` is given."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    return df if run_id is None else df.where(F.col("run_id") == run_id)
