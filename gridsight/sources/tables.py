"""Scans and what can be said about a table before any analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridsight.functions.parsing import NULL_TOKENS, as_text


class EmptyTableError(ValueError):
    """The table has no columns or no rows."""


class TableTooLargeError(ValueError):
    """The table exceeds a row or column limit the caller asked for."""


def normalise_nulls(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Turn the missing-value tokens of text columns into nulls."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`")
        for c in df.columns
    ])


def read_text_columns(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                      multi_line: bool = True) -> DataFrame:
    """CSV scan with every column as text and missing tokens as null.

    Quoted cells may hold line breaks; a file is then read by one task. For a folder of large files
    without such cells pass ``multi_line=False``, which splits files.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding,
                         quote='"', escape='"', multiLine=multi_line)
    return normalise_nulls(raw)


def text_columns(df: DataFrame) -> DataFrame:
    """Any table as the text-only scan would deliver it."""
    return normalise_nulls(df.select(*[as_text(df, c).alias(c) for c in df.columns]))


def read_typed(spark: SparkSession, path: str, view: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Typed scan, optionally registered as a SQL view.

    Parquet and ORC carry their types. For CSV pass a schema where you can: type
    inference reads the whole input once more.
    """
    if path.rstrip("/").endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    elif path.rstrip("/").endswith(".orc"):
        df = spark.read.orc(path)
    elif path.rstrip("/").endswith((".csv", ".tsv", ".txt")):
        sep = "\t" if path.rstrip("/").endswith(".tsv") else ","
        reader = spark.read.option("header", True).option("sep", sep)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        df = spark.read.load(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def table_guard(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """One row: counts and whether the table is empty or over the optional limits."""
    too_wide = max_columns is not None and len(df.columns) > max_columns
    rows = F.col("row_count")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(len(df.columns) == 0).alias("no_columns"),
        (rows == 0).alias("no_rows"),
        (F.lit(False) if max_rows is None else rows > max_rows).alias("too_many_rows"),
        F.lit(too_wide).alias("too_many_columns"),
        F.when((rows == 0) | F.lit(len(df.columns) == 0), "EMPTY")
        .when(F.lit(too_wide) | (F.lit(False) if max_rows is None else rows > max_rows), "TOO_LARGE")
        .otherwise("OK").alias("verdict"),
    )


def require_table(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """The table itself, or an error. Reads one row unless a row limit is set."""
    if not df.columns:
        raise EmptyTableError("the table has no columns")
    if max_columns is not None and len(df.columns) > max_columns:
        raise TableTooLargeError(f"{len(df.columns)} columns, limit {max_columns}")
    if df.isEmpty():
        raise EmptyTableError("the table has no rows")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise TableTooLargeError(f"more than {max_rows} rows")
    return df


def table_metadata(df: DataFrame, order_by: list[str], samples: int = 5) -> DataFrame:
    """One row per column: position, type, table counts, and the first values by key.

    ``order_by`` makes the sample deterministic; it compiles to a top-k, not a sort.
    """
    names = df.columns
    head = df.orderBy(*order_by).limit(samples)
    gathered = head.agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.struct(*[F.col(f"`{k}`").alias(f"k{j}") for j, k in enumerate(order_by)],
                                                 as_text(df, c).alias("v")))),
            lambda s: s["v"],
        ).alias(f"s{i}")
        for i, c in enumerate(names)
    ])
    per_column = gathered.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                 F.col(f"s{i}").alias("sample_values"))
        for i, c in enumerate(names)
    ])).alias("c")).select("c.*")
    rows = df.agg(F.count(F.lit(1))).scalar()
    return per_column.select(
        "*", rows.alias("row_count"), F.lit(len(names)).cast("bigint").alias("column_count"))
