"""Ad-hoc selection: columns or aggregates, conjunctive filters, group, sort, limit."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def where_all(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Keep rows matching every entry: a value, a list of values, or None for null."""
    for name, wanted in filters.items():
        column = F.col(f"`{name}`")
        if wanted is None:
            df = df.where(column.isNull())
        elif isinstance(wanted, (list, tuple, set)):
            df = df.where(column.isin(list(wanted)))
        else:
            df = df.where(column == F.lit(wanted))
    return df


def kpi_data(df: DataFrame, columns: list[str], filters: dict[str, Any] | None = None,
             group_by: list[str] | None = None, order_by: list[Column | str] | None = None,
             limit: int | None = None) -> DataFrame:
    """``SELECT columns WHERE filters GROUP BY … ORDER BY … LIMIT``.

    With ``group_by`` the ``columns`` are aggregate expressions such as
    ``"sum(price) AS revenue"``; without it they are plain expressions.
    """
    out = where_all(df, filters or {})
    if group_by:
        out = out.groupBy(*group_by).agg(*[F.expr(c) for c in columns])
    elif columns != ["*"]:
        out = out.select(*[F.expr(c) for c in columns])
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(limit) if limit else out


def period_filter(df: DataFrame, date_column: str, year: int | None = None, quarter: int | None = None,
                  fiscal_year: int | None = None, fiscal_start_month: int = 1,
                  ytd_flag: str | None = None, **dimensions: Any) -> DataFrame:
    """Rows of a calendar year, quarter, fiscal year (``FY2024`` ends in 2024) or year to date.

    A year becomes a range over the date, which the parquet reader can prune by; a
    quarter alone has to look at every row.
    """
    date = F.col(f"`{date_column}`")
    if year is not None:
        low, high = (year, 1), (year + 1, 1)
        if quarter is not None:
            low = (year, 3 * quarter - 2)
            high = (year, 3 * quarter + 1) if quarter < 4 else (year + 1, 1)
        df = df.where((date >= _first_of(*low)) & (date < _first_of(*high)))
    elif quarter is not None:
        df = df.where(F.quarter(date) == quarter)
    if fiscal_year is not None:
        start = fiscal_year if fiscal_start_month == 1 else fiscal_year - 1
        df = df.where((date >= _first_of(start, fiscal_start_month))
                      & (date < _first_of(start + 1, fiscal_start_month)))
    if ytd_flag is not None:
        df = df.where(F.col(f"`{ytd_flag}`") == "Y")
    return where_all(df, dimensions)


def _first_of(year: int, month: int) -> Column:
    return F.lit(f"{year:04d}-{month:02d}-01").cast("timestamp_ntz")


def value_distribution(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent values of a column, nulls left out, ties by value."""
    value = F.col(f"`{column}`")
    return (
        df.where(value.isNotNull()).groupBy(value.cast("string").alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("value")).limit(top)
    )
