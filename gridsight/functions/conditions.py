"""A small, safe condition language: comparisons, AND/OR/NOT, arithmetic and abs().

The text is checked against a token whitelist and the caller's column list, then
handed to Spark's own expression parser, so it is evaluated for every row in codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_TOKEN = re.compile(r"\s*(>=|<=|==|!=|<>|[-+*/()<>=]|[0-9]+\.?[0-9]*|[A-Za-z_][A-Za-z0-9_]*)")
_WORDS = {"and", "or", "not", "abs"}
_COMPARISONS = {">=", "<=", "==", "!=", "<>", "<", ">", "="}


class ConditionError(ValueError):
    """The text is not a condition of the allowed form."""


def names_in(text: str) -> set[str]:
    """Column names a condition mentions; raises on any token outside the language."""
    found, position, compared = set(), 0, False
    text = text.strip()
    while position < len(text):
        match = _TOKEN.match(text, position)
        if not match:
            raise ConditionError(f"not allowed in a condition: {text[position:]!r}")
        token, position = match.group(1), match.end()
        compared |= token in _COMPARISONS
        if re.match(r"[A-Za-z_]", token) and token.lower() not in _WORDS:
            if text[position:].lstrip().startswith("("):
                raise ConditionError(f"only abs() may be called: {token!r}")
            found.add(token)
    if not compared:
        raise ConditionError(f"not a comparison: {text!r}")
    return found


def condition(text: str, columns: list[str]) -> Column:
    """The condition as a column; every name must be one of ``columns``."""
    unknown = names_in(text) - set(columns)
    if unknown:
        raise ConditionError(f"unknown columns {sorted(unknown)} in {text!r}")
    return F.expr(text)
