"""The registered queries. Importing this package registers all of them."""

from gridsight.queries.registry import QUERIES, SQL, query
from gridsight.queries import catalogs, kpis, models, outliers, profiling, rules_quality, scans, statistics, structure  # noqa: F401

__all__ = ["QUERIES", "SQL", "query"]
