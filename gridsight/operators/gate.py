"""Quality gate: ten weighted checks, each scoring between 0 and its weight.

All cell-level checks are one aggregate over ``cells`` (a row per cell). Only two
checks need more: equal rows (a grouping by row digest) and length outliers, whose
second pass needs each column's mean and deviation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.parsing import (
    PLACEHOLDERS, cells, kinds, missing, text_to_number, text_to_time)
from gridsight.functions.scale import row_copies

# Weights, pass mark and limits of the gate.
WEIGHTS = {
    "column_count": 15, "missing_values": 20, "duplicate_columns": 5, "duplicate_rows": 5,
    "empty_columns": 10, "datatype_consistency": 15, "corrupted_values": 10,
    "null_heavy_rows": 10, "cell_length_outliers": 5, "mixed_formats": 5,
}
PASSING_SCORE = 75
LIMITS = {
    "min_columns": 1, "max_missing_values_pct": 20.0, "max_single_column_missing_pct": 50.0,
    "max_duplicate_rows_pct": 10.0, "max_empty_columns_pct": 10.0,
    "min_datatype_consistency_pct": 80.0, "max_corrupted_values_pct": 5.0,
    "max_null_heavy_rows_pct": 10.0, "max_cell_length_outliers_pct": 5.0,
    "max_mixed_formats_pct": 10.0, "null_heavy_row_pct_threshold": 50.0,
    "free_text_min_avg_words": 4, "free_text_min_avg_length": 40,
}

# Words of one capital and then lower case only, with something uncased between words.
_UNCASED = r"[^\p{Lu}\p{Ll}\p{Lt}]"
_TITLE = rf"^{_UNCASED}*\p{{Lu}}\p{{Ll}}*({_UNCASED}+\p{{Lu}}\p{{Ll}}*)*{_UNCASED}*$"


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, True))


def _casing(value: Column) -> Column:
    """``upper``, ``lower``, ``title`` or ``mixed``; text without letters is mixed."""
    has_letter = value.rlike(r"\p{L}")
    return (
        F.when(has_letter & (F.upper(value) == value), "upper")
        .when(has_letter & (F.lower(value) == value), "lower")
        .when(has_letter & value.rlike(_TITLE), "title")
        .otherwise("mixed")
    )


def _kind_of_cell(value: Column, native: Column) -> Column:
    plain = F.trim(value)
    return (
        F.when(native != "text", native)
        .when(text_to_number(plain).isNotNull(), "number")
        .when(F.lower(plain).isin("true", "false"), "boolean")
        .when(text_to_time(plain).isNotNull(), "time")
        .otherwise("text")
    )


def column_checks(df: DataFrame) -> DataFrame:
    """Per column: every count the cell-level checks need, in one pass."""
    native_kinds = kinds(df)
    native = F.create_map(*[F.lit(x) for item in native_kinds.items() for x in item])[F.col("column")]
    cell = cells(df).withColumn("native", native)
    value, is_text = F.col("value"), F.col("native") == "text"
    cell = cell.withColumn("kind", F.when(value.isNotNull(), _kind_of_cell(value, F.col("native"))))
    words = F.size(F.split(F.trim(value), r"\s+"))
    solid = is_text & (F.trim(value) != "")
    cell = cell.withColumn("casing", F.when(solid, _casing(value)))
    text_value = F.when(is_text, value)
    return cell.groupBy("column").agg(
        F.count("*").alias("rows"),
        F.count("value").alias("filled"),
        *[_count_if(F.col("kind") == k).alias(f"as_{k}") for k in ("boolean", "number", "time", "text")],
        _count_if(F.lower(F.trim(value)).isin(PLACEHOLDERS)).alias("placeholders"),
        F.count(text_value).alias("strings"),
        F.avg(F.when(is_text, F.when(F.trim(value) == "", 0).otherwise(words))).alias("mean_words"),
        F.avg(F.length(text_value)).alias("mean_length"),
        F.stddev_pop(F.length(text_value)).alias("sd_length"),
        _count_if(solid).alias("solid_strings"),
        F.avg(F.when(solid, words)).alias("solid_mean_words"),
        F.avg(F.when(solid, F.length(value))).alias("solid_mean_length"),
        *[_count_if(F.col("casing") == k).alias(f"case_{k}") for k in ("upper", "lower", "title", "mixed")],
    )


def _consistency() -> Column:
    top = F.greatest("as_boolean", "as_number", "as_time", "as_text")
    return F.when(F.col("filled") == 0, 1.0).otherwise(top / F.col("filled"))


def _casing_share() -> Column:
    top = F.greatest("case_upper", "case_lower", "case_title", "case_mixed")
    return F.try_divide(top.cast("double"), F.col("solid_strings").cast("double"))


def missing_values(checks: DataFrame) -> DataFrame:
    """Missing share per column."""
    return checks.select("column", "rows", (F.col("rows") - F.col("filled")).alias("missing"),
                         _share(F.col("rows") - F.col("filled"), F.col("rows")).alias("missing_share"))


def type_consistency(checks: DataFrame) -> DataFrame:
    """Share of the most common apparent type per column; 1 for an empty column."""
    return checks.select("column", "filled", "as_boolean", "as_number", "as_time", "as_text",
                         _consistency().alias("consistency"))


def casing_consistency(checks: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Share of the most common casing per text column, free text left out."""
    free = ((F.col("solid_mean_words") >= limits["free_text_min_avg_words"])
            | (F.col("solid_mean_length") >= limits["free_text_min_avg_length"]))
    return checks.where((F.col("solid_strings") > 0) & ~free).select(
        "column", "solid_strings", "case_upper", "case_lower", "case_title", "case_mixed",
        _casing_share().alias("consistency"))


def length_outliers(df: DataFrame, checks: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """``checks`` plus, per column, how many strings lie over three deviations from the
    mean length, and how many strings were looked at (none in free-text columns)."""
    free = ((F.col("mean_words") >= limits["free_text_min_avg_words"])
            | (F.col("mean_length") >= limits["free_text_min_avg_length"]))
    eligible = (F.col("strings") >= 3) & ~F.coalesce(free, F.lit(False))
    text = [c for c, k in kinds(df).items() if k == "text"]
    if not text:
        zero = F.lit(0).cast("bigint")
        return checks.withColumn("length_checked", zero).withColumn("length_outliers", zero)
    # A length has few distinct values, so counting them first leaves a tiny join.
    lengths = (cells(df, text).where(F.col("value").isNotNull())
               .groupBy("column", F.length("value").alias("length")).agg(F.count("*").alias("copies")))
    far = (F.abs(F.col("length") - F.col("mean_length")) > 3 * F.col("sd_length")) & (F.col("sd_length") > 0)
    kept = [F.first(c).alias(c) for c in checks.columns if c != "column"]
    return (
        checks.join(lengths, "column", "left").groupBy("column")
        .agg(*kept, F.coalesce(F.sum(F.when(far, F.col("copies"))), F.lit(0)).alias("far"))
        .withColumn("length_checked", F.when(eligible, F.col("strings")).otherwise(0))
        .withColumn("length_outliers", F.when(eligible, F.col("far")).otherwise(0)).drop("far")
    )


def null_heavy_rows(df: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """One row: how many rows are missing more than half of their cells."""
    holes = sum((missing(df, c).cast("int") for c in df.columns), F.lit(0))
    share = holes / F.lit(float(len(df.columns))) * 100
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        _count_if(share > limits["null_heavy_row_pct_threshold"]).alias("null_heavy"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each set of equal rows, null equal to null."""
    return row_copies(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def quality_gate(df: DataFrame, weights: dict[str, float] = WEIGHTS, limits: dict = LIMITS,
                 passing: float = PASSING_SCORE) -> DataFrame:
    """One row per check: ``check, weight, score, warning`` plus the dataset verdict."""
    checks = length_outliers(df, column_checks(df), limits)
    width = len(df.columns)
    repeated = width - len(set(df.columns))
    free = ((F.col("solid_mean_words") >= limits["free_text_min_avg_words"])
            | (F.col("solid_mean_length") >= limits["free_text_min_avg_length"]))
    cased = (F.col("solid_strings") > 0) & ~free
    holes = F.col("rows") - F.col("filled")
    per_cell = checks.agg(
        F.sum(holes).alias("holes"), F.sum("rows").alias("cells"),
        F.max(_share(holes, F.col("rows"))).alias("worst"),
        F.max_by("column", F.struct(_share(holes, F.col("rows")), F.col("column"))).alias("worst_column"),
        _count_if(F.col("filled") == 0).alias("empty"),
        F.sum("filled").alias("filled"), F.sum("placeholders").alias("placeholders"),
        F.avg(_consistency()).alias("typed"),
        F.avg(F.when(cased, _casing_share())).alias("cased"),
        F.sum("length_outliers").alias("long_cells"), F.sum("length_checked").alias("strings"))
    heavy = null_heavy_rows(df, limits).select(F.struct(F.col("rows").alias("n"), F.col("null_heavy")).alias("h"))
    one = per_cell.select(
        "*", heavy.scalar().alias("h"),
        duplicate_rows(df).select("duplicates").scalar().alias("duplicates")).select("*", "h.*")

    col = F.col
    missing_share = F.greatest(_share(col("holes"), col("cells")), col("worst"))
    rows = [
        ("column_count", F.lit(1.0 if width >= limits["min_columns"] else 0.0),
         F.when(F.lit(width < limits["min_columns"]), "too few columns")),
        ("missing_values", 1 - missing_share,
         F.concat_ws("; ",
                     F.when(_share(col("holes"), col("cells")) * 100 > limits["max_missing_values_pct"], "missing values over threshold"),
                     F.when(col("worst") * 100 > limits["max_single_column_missing_pct"],
                            F.concat(F.lit("mostly missing column "), col("worst_column"))))),
        ("duplicate_columns", F.lit(1 - repeated / width if width else 1.0),
         F.when(F.lit(repeated > 0), "duplicate column names")),
        ("duplicate_rows", 1 - _share(col("duplicates"), col("n")),
         F.when(_share(col("duplicates"), col("n")) * 100 > limits["max_duplicate_rows_pct"], "duplicate rows over threshold")),
        ("empty_columns", 1 - _share(col("empty"), F.lit(width)),
         F.when(_share(col("empty"), F.lit(width)) * 100 > limits["max_empty_columns_pct"], "empty columns over threshold")),
        ("datatype_consistency", F.coalesce(col("typed"), F.lit(1.0)),
         F.when(col("typed") * 100 < limits["min_datatype_consistency_pct"], "mixed types under threshold")),
        ("corrupted_values", 1 - _share(col("placeholders"), col("filled")),
         F.when(_share(col("placeholders"), col("filled")) * 100 > limits["max_corrupted_values_pct"], "placeholders over threshold")),
        ("null_heavy_rows", 1 - _share(col("null_heavy"), col("n")),
         F.when(_share(col("null_heavy"), col("n")) * 100 > limits["max_null_heavy_rows_pct"], "null-heavy rows over threshold")),
        ("cell_length_outliers", 1 - _share(col("long_cells"), col("strings")),
         F.when(_share(col("long_cells"), col("strings")) * 100 > limits["max_cell_length_outliers_pct"], "length outliers over threshold")),
        ("mixed_formats", F.coalesce(col("cased"), F.lit(1.0)),
         F.when((1 - col("cased")) * 100 > limits["max_mixed_formats_pct"], "mixed casing over threshold")),
    ]
    scores = {name: F.greatest(F.lit(0.0), part.cast("double") * float(weights.get(name, 0))) for name, part, _ in rows}
    total = sum(scores.values(), F.lit(0.0))
    table = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("check"), F.lit(float(weights.get(name, 0))).alias("weight"),
                 F.round(scores[name], 2).alias("score"), F.coalesce(warning, F.lit("")).alias("warning"))
        for i, (name, _, warning) in enumerate(rows)
    ])
    return one.select(F.explode(table).alias("r"), F.round(total, 2).alias("dataset_score"),
                      F.when(total >= passing, "PASS").otherwise("FAIL").alias("decision"),
                      col("n").alias("rows_analyzed")).select("r.*", "dataset_score", "decision", "rows_analyzed")
