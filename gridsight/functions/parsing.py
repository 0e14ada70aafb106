"""Lenient parsing: text to number, time and boolean, null on anything else.

Spark 4 runs in ANSI mode, so a bad ``cast`` fails the job. Everything here uses
``try_*`` functions behind a shape check, because the engine also accepts text such
as ``1d`` or ``123456`` (a year) that a data profile must not call a number or a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text read as missing on a string scan.
NULL_TOKENS = ["", "NA", "N/A", "null", "NULL", "None", "none", "nan", "NaN",
               "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "n/a"]

# Text counted as a corrupted placeholder by the quality gate.
PLACEHOLDERS = ["?", "n/a", "na", "null", "none", "undefined", "nan"]

# Text read as a boolean by the profiler.
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "on", "off"]

NUMBER_SHAPE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ISO_SHAPE = r"^\s*[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2}([T ][0-9].*)?)?\s*$"
SLASH_SHAPE = r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(data_type: T.DataType) -> str:
    """``number``, ``time``, ``boolean``, ``text`` or ``nested``."""
    if isinstance(data_type, NUMERIC_TYPES):
        return "number"
    if isinstance(data_type, TEMPORAL_TYPES):
        return "time"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "nested"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind == "number"]


def finite(value: Column) -> Column:
    """The number; null for NaN (greater than any number here) and for both infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def text_to_number(value: Column) -> Column:
    """Text such as ``1e999`` reads as infinity and so is no number."""
    return finite(F.when(value.rlike(NUMBER_SHAPE), F.trim(value).try_cast("double")))


def text_to_time(value: Column) -> Column:
    return (
        F.when(value.rlike(ISO_SHAPE), F.trim(value).try_cast("timestamp"))
        .when(value.rlike(SLASH_SHAPE), F.try_to_timestamp(F.trim(value), F.lit("M/d/yyyy")))
    )


def is_boolean_text(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(BOOLEAN_TOKENS)


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; null where it does not hold a finite number."""
    kind = kind_of(df.schema[name].dataType)
    value = F.col(f"`{name}`")
    if kind == "number":
        real = value.cast("double")
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            return finite(real)
        return real
    if kind == "boolean":
        return value.cast("int").cast("double")
    if kind == "text":
        return text_to_number(value)
    return F.lit(None).cast("double")


def moment(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; null where it does not parse."""
    kind = kind_of(df.schema[name].dataType)
    value = F.col(f"`{name}`")
    if kind == "time":
        return value.cast("timestamp_ntz")
    if kind == "text":
        return text_to_time(value).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text; nested columns as JSON."""
    value = F.col(f"`{name}`")
    if kind_of(df.schema[name].dataType) == "nested":
        return F.when(value.isNotNull(), F.to_json(value))
    return value.cast("string")


def missing(df: DataFrame, name: str) -> Column:
    """Null, and NaN for floating point, count as missing."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def cells(df: DataFrame, columns: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """One row per cell: ``column``, ``value`` (text, null when missing), plus ``keep``.

    Everything measured per column is an aggregate over this frame keyed by
    ``column``, so the number of expressions does not grow with the table's width and
    map-side combining leaves one row per column and task.
    """
    columns = columns or df.columns
    return _unpivoted(df, columns, [F.when(~missing(df, c), as_text(df, c)) for c in columns], keep, "value")


def _unpivoted(df: DataFrame, columns: list[str], values: list[Column], keep: list[str], name: str) -> DataFrame:
    """Columns as rows of ``column`` and a value; kept columns step aside meanwhile."""
    held = [f"_kept_{i}" for i in range(len(keep))]
    wide = df.select(*[F.col(f"`{k}`").alias(h) for k, h in zip(keep, held)],
                     *[value.alias(c) for c, value in zip(columns, values)])
    long = wide.unpivot(held, [f"`{c}`" for c in columns], "column", name)
    return long.select(*[F.col(h).alias(k) for k, h in zip(keep, held)], "column", name)


def measures(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per number: ``column``, ``x``, plus ``keep``; missing cells are dropped."""
    return _unpivoted(df, columns, [number(df, c) for c in columns], keep, "x").where(F.col("x").isNotNull())
