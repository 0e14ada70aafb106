"""Dataset and column profiles.

Counts per column come from one grouping of cells by ``(column, value)``: it gives
exact distinct counts and value frequencies together, combines heavy hitters before
the shuffle, and needs no distinct aggregate per column. Number, length and pattern
statistics are one aggregate keyed by column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridsight.functions.parsing import (
    cells, is_boolean_text, text_to_number, text_to_time)
from gridsight.functions.quantiles import quantiles
from gridsight.functions.scale import row_copies

MAX_SAMPLES = 10

# Pattern labels, in order of detection.
PATTERNS = {
    "YYYY-MM-DD": r"^\d{4}-\d{2}-\d{2}$",
    "ISO_DATETIME": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    "MM/DD/YYYY": r"^\d{2}/\d{2}/\d{4}$",
    "DATE_SLASH": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "THREE_LETTER_CODE": r"^[A-Z]{3}$",
    "TWO_LETTER_CODE": r"^[A-Z]{2}$",
    "UUID": r"^[a-f0-9\-]{36}$",
    "EMAIL": r"^[\w.+-]+@[\w-]+\.[\w.]+$",
    "PHONE": r"^(?=.*[\s\-\(\)+])\+?\d[\d\s\-\(\)]{7,}$",
    "DECIMAL_2DP": r"^\d+\.\d{2}$",
    "INTEGER": r"^\d+$",
    "NUMERIC": r"^-?\d+\.?\d*$",
}


def normalised_keys(names: list[str]) -> list[str]:
    """Names as ``[a-z0-9_]`` keys, repeated ones told apart by ``_1``, ``_2`` …"""
    plain = [re.sub(r"[^a-z0-9]+", "_", n.lower()).strip("_") or "column" for n in names]
    seen: dict[str, int] = {}
    keys = []
    for key in plain:
        repeat = seen.get(key, 0)
        seen[key] = repeat + 1
        keys.append(key if repeat == 0 else f"{key}_{repeat}")
    return keys


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: row and column counts, duplicate rows, text bytes, keys, repeated keys."""
    keys = normalised_keys(df.columns)
    plain = [re.sub(r"_\d+$", "", k) if keys.count(k) == 1 and k not in normalised_keys([n]) else k
             for k, n in zip(keys, df.columns)]
    repeated = sorted({k for k in plain if plain.count(k) > 1})
    size = cells(df).agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)))
    return row_copies(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_row_count"),
    ).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "duplicate_row_count",
        size.scalar().alias("text_bytes"),
        F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("normalized_keys"),
        F.array(*[F.lit(k) for k in repeated]).cast("array<string>").alias("duplicate_column_names"))


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, copies`` for every distinct cell value, null included."""
    return cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("copies"))


def hashed_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, copies`` like ``value_frequencies``, with two 64-bit hashes in place of each value's text.

    Long and near-unique columns shuffle 16 bytes a value. Two values of n collide with probability about n^2 / 2^129.
    """
    value = F.when(F.col("value").isNotNull(), F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit("second"), "value").alias("b")))
    return cells(df, columns).select("column", value.alias("value")).groupBy("column", "value").agg(F.count("*").alias("copies"))


def column_counts(df: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """Per column: rows, nulls, distinct values, cardinality, duplicates, warnings."""
    freq = frequencies if frequencies is not None else hashed_frequencies(df)
    filled = F.col("value").isNotNull()
    counted = freq.groupBy("column").agg(
        F.sum("copies").alias("row_count"),
        F.coalesce(F.sum(F.when(filled, F.col("copies"))), F.lit(0)).alias("non_null_count"),
        F.count("value").alias("distinct_count"))
    return _with_ratios(counted)


def _with_ratios(counted: DataFrame) -> DataFrame:
    nulls = F.col("row_count") - F.col("non_null_count")
    high = F.col("null_ratio") > 0.5
    unique = (F.col("cardinality_ratio") > 0.98) & (F.col("non_null_count") > 10)
    return (
        counted.withColumn("null_count", nulls)
        .withColumn("null_ratio", F.when(F.col("row_count") > 0, nulls / F.col("row_count")).otherwise(0.0))
        .withColumn("cardinality_ratio", F.when(F.col("non_null_count") > 0,
                                                F.col("distinct_count") / F.col("non_null_count")).otherwise(0.0))
        .withColumn("duplicate_count", F.greatest(F.lit(0), F.col("non_null_count") - F.col("distinct_count")))
        .withColumn("warning", F.concat_ws("; ", F.when(high, "high null ratio"), F.when(unique, "near-unique column")))
    )


def _text_statistics(weight: Column) -> list[Column]:
    """Aggregates over ``value``, each value counting ``weight`` times."""
    value = F.col("value")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))
    return [
        F.min(F.length(value)).alias("min_string_length"),
        F.max(F.length(value)).alias("max_string_length"),
        F.sum(F.when(value.isNotNull(), F.length(value) * weight)).alias("total_string_length"),
        total(text_to_number(value).isNotNull()).alias("numbers"),
        total(text_to_time(value).isNotNull()).alias("times"),
        total(is_boolean_text(value)).alias("booleans"),
        *[total(value.rlike(p)).alias(f"is_{i}") for i, p in enumerate(PATTERNS.values())],
    ]


def column_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: shortest, longest and mean text length."""
    length = F.length("value")
    return cells(df, columns).groupBy("column").agg(
        F.min(length).alias("min_string_length"), F.max(length).alias("max_string_length"),
        F.avg(length).alias("avg_string_length"))


def parse_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: share of values that read as a number, a date or time, a boolean."""
    value = F.col("value")
    ratio = lambda ok: F.coalesce(F.try_divide(F.count(F.when(ok, True)).cast("double"), F.count(value).cast("double")), F.lit(0.0))
    return cells(df, columns).groupBy("column").agg(
        ratio(text_to_number(value).isNotNull()).alias("numeric_parse_ratio"),
        ratio(text_to_time(value).isNotNull()).alias("datetime_parse_ratio"),
        ratio(is_boolean_text(value)).alias("boolean_parse_ratio"))


def column_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per mostly numeric column: range, mean, median, sample deviation, quartiles.

    Deviation is 0 for a single value; ``all_integer_valued`` looks at every value.
    """
    value = F.col("value")
    cell = cells(df, columns).select("column", "value", text_to_number(value).alias("x"))
    stats = cell.groupBy("column").agg(
        F.count("value").alias("filled"), F.count("x").alias("numeric_count"),
        F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.avg("x").alias("mean"),
        F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std_dev"),
        F.bool_and(F.col("x") % 1 == 0).alias("all_integer_valued"),
    ).where((F.col("numeric_count") > 0) & (F.col("numeric_count") > 0.5 * F.col("filled")))
    probs = quantiles(df, columns or df.columns, [0.25, 0.5, 0.75])
    wide = probs.groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return (
        stats.join(wide, "column", "left")
        .select("column", "numeric_count", "min_value", "max_value", "mean", F.col("q50").alias("median"),
                "std_dev", "q25", "q50", "q75", "all_integer_valued")
    )


def pattern_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, pattern, matches, ratio`` for the patterns most values follow, five at most."""
    value = F.col("value")
    counted = cells(df, columns).groupBy("column").agg(
        F.count("value").alias("filled"),
        *[F.count(F.when(value.rlike(p), True)).alias(f"is_{i}") for i, p in enumerate(PATTERNS.values())])
    long = counted.select("column", "filled", F.explode(_pattern_array()).alias("p")).select(
        "column", "filled", "p.*").where(F.col("matches") > 0.5 * F.col("filled"))
    # At most twelve rows per column reach this window.
    best = W.partitionBy("column").orderBy(F.desc("matches"), F.asc("position"))
    return (
        long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 5)
        .select("column", "pattern", "matches", (F.col("matches") / F.col("filled")).alias("ratio"), "rank")
    )


def _pattern_array() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("pattern"), F.col(f"is_{i}").alias("matches"))
        for i, label in enumerate(PATTERNS)])


def representative_values(df: DataFrame, columns: list[str] | None = None, top: int = MAX_SAMPLES,
                          frequencies: DataFrame | None = None) -> DataFrame:
    """The most frequent values per column, ties by value.

    The rank filter is pushed below the shuffle (a window group limit), so each task
    sends at most ``top`` values per column.
    """
    freq = frequencies if frequencies is not None else value_frequencies(df, columns)
    # Nulls sort last and leave after the cut, so that the counts beneath are the very
    # ones other parts of a profile use and are computed once.
    best = W.partitionBy("column").orderBy(F.col("value").isNull(), F.desc("copies"), F.asc("value"))
    return (
        freq.withColumn("rank", F.row_number().over(best))
        .where((F.col("rank") <= top) & F.col("value").isNotNull())
        .select("column", "value", "copies", "rank")
    )


def sample_values(df: DataFrame, order_by: list[str], columns: list[str] | None = None,
                  top: int = MAX_SAMPLES) -> DataFrame:
    """The first non-null values of each column in the order of a key."""
    columns = columns or df.columns
    keyed = cells(df, columns, keep=order_by).where(F.col("value").isNotNull())
    first = W.partitionBy("column").orderBy(*order_by)
    return (
        keyed.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        .select("column", "value", "rank")
    )


def column_profiles(df: DataFrame) -> DataFrame:
    """The whole profile, one row per column.

    Two passes over the data: value frequencies (counts, lengths, parse ratios,
    patterns and top values all follow from them) and number statistics.
    """
    freq = value_frequencies(df)
    filled = F.col("value").isNotNull()
    base = freq.groupBy("column").agg(
        F.sum("copies").alias("row_count"),
        F.coalesce(F.sum(F.when(filled, F.col("copies"))), F.lit(0)).alias("non_null_count"),
        F.count("value").alias("distinct_count"),
        *_text_statistics(F.col("copies")))
    base = _with_ratios(base)
    part = lambda c: F.when(F.col("non_null_count") > 0, F.col(c) / F.col("non_null_count")).otherwise(0.0)
    by_count = F.array_sort(
        F.filter(_pattern_array(), lambda p: p["matches"] > 0.5 * F.col("non_null_count")),
        lambda a, b: F.when(a["matches"] != b["matches"], (b["matches"] - a["matches"]).cast("int")).otherwise(a["position"] - b["position"]))
    base = (
        base.withColumn("avg_string_length", F.try_divide(F.col("total_string_length"), F.col("non_null_count")))
        .withColumn("numeric_parse_ratio", part("numbers"))
        .withColumn("datetime_parse_ratio", part("times"))
        .withColumn("boolean_parse_ratio", part("booleans"))
        .withColumn("dominant_patterns", F.slice(F.transform(by_count, lambda p: p["pattern"]), 1, 5))
    )
    tops = (
        representative_values(df, frequencies=freq).groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
        .select("column", F.transform("v", lambda s: s["value"]).alias("representative_values"))
    )
    numbers = column_numbers(df).drop("numeric_count")
    keys = dict(zip(df.columns, normalised_keys(df.columns)))
    names = F.create_map(*[F.lit(x) for item in keys.items() for x in item])
    places = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    return (
        base.join(tops, "column", "left").join(numbers, "column", "left")
        .select(
            places[F.col("column")].alias("position"), "column", names[F.col("column")].alias("normalized_key"),
            "row_count", "non_null_count", "null_count", "null_ratio", "distinct_count", "cardinality_ratio",
            "duplicate_count", "min_value", "max_value", "mean", "median", "std_dev", "q25", "q50", "q75",
            "all_integer_valued", "min_string_length", "max_string_length", "avg_string_length",
            "numeric_parse_ratio", "datetime_parse_ratio", "boolean_parse_ratio", "dominant_patterns",
            F.coalesce("representative_values", F.array().cast("array<string>")).alias("representative_values"),
            "warning")
    )
