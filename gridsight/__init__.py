"""Table profiling, rule checking and analytics as Spark DataFrame operators."""

from gridsight.session import build_session

__all__ = ["build_session"]
