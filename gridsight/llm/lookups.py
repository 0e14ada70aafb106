"""Joins of rows with one total per key, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more than one in so many of the whole weight is hot; so there are fewer than this many hot keys.
SHARE = 1000


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str], weight: str, share: int = SHARE) -> DataFrame:
    """Rows with the columns of the ``totals`` row of their keys; rows without one are left out.

    ``weight`` must be a column of ``totals`` that is not negative and grows with the rows a key may have. Hot keys are
    broadcast, fewer than ``share`` of them by construction; the others meet in a shuffle, where none is large.
    """
    whole = totals.agg(F.sum(F.col(weight).cast("decimal(38,0)"))).scalar()
    heavy = F.col(weight).cast("decimal(38,0)") * share > whole
    hot = F.broadcast(totals.filter(heavy))
    cold = rows.join(F.broadcast(totals.filter(heavy).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(totals.filter(~heavy), keys))
