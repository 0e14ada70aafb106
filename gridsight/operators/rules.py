"""Constraint rules over a table, mined invariants, and KPI threshold rules.

A run's rules compile into one aggregate (a few counters per rule); only uniqueness
needs a grouping of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.conditions import condition, names_in
from gridsight.functions.parsing import as_text, missing, moment, number, numeric_columns
from gridsight.operators.profile import hashed_frequencies
from gridsight.plans import vocabulary as V

RULE_TYPES = [
    "non_null", "expected_unique", "regex_match", "allowed_values", "numeric_range", "date_range",
    "column_comparison", "cross_field_equality", "cross_field_inequality", "conditional_required",
]
_OPERATORS = {
    ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
RULES_PER_AGGREGATE = 40
PAIRS_PER_AGGREGATE = 60

_RULE_ROW = ("rule_key string, rule_type string, severity string, source string, target string, "
             "records_checked bigint, pass_count bigint, fail_count bigint, score double, error string")


@dataclass(frozen=True)
class Rule:
    rule_key: str
    rule_type: str
    parameters: dict[str, Any] = field(default_factory=dict)
    severity: str = "medium"
    source: str = "request"
    active: bool = True


def load_rules(raw: list[dict[str, Any]], source: str = "request") -> list[Rule]:
    """Rules from plain dictionaries; entries of an unknown type are left out."""
    rules = []
    for entry in raw:
        if entry.get("type") not in RULE_TYPES:
            continue
        own = {"rule_key", "type", "severity", "active", "secondary_domains"}
        rules.append(Rule(
            rule_key=entry.get("rule_key", f"request_rule_{len(rules)}"), rule_type=entry["type"],
            parameters={k: v for k, v in entry.items() if k not in own},
            severity=entry.get("severity", "medium"), source=source, active=entry.get("active", True)))
    return rules


def domain_rules(domain: str, secondary: str | None = None) -> list[Rule]:
    """The rule pack of a domain, without rules bound to another secondary domain."""
    raw = [r for r in V.DOMAINS[domain.lower()]["business_rules"]
           if not (secondary and r.get("secondary_domains") and secondary not in r["secondary_domains"])]
    return load_rules(raw, "domain_configuration")


def role_map(described: DataFrame) -> dict[str, str]:
    """Semantic type to column name; a profile has one small row per column."""
    rows = described.where(F.col("semantic_type").isNotNull()).select("position", "semantic_type", "column").collect()
    return {r["semantic_type"]: r["column"] for r in sorted(rows, key=lambda r: r["position"])}


def evaluate_rules(df: DataFrame, rules: list[Rule], roles: dict[str, str] | None = None) -> DataFrame:
    """One row per active rule: rows checked, passed, failed, score, error."""
    roles = roles or {}
    counted, unique, failed = [], [], []
    for rule in (r for r in rules if r.active):
        try:
            target, checked, passed, empty_score = _counters(df, rule, roles)
        except _Skip as reason:
            failed.append((rule.rule_key, rule.rule_type, rule.severity, rule.source, "", 0, 0, 0, 0.0, str(reason)))
            continue
        if rule.rule_type == "expected_unique":
            unique.append((rule, target))
        else:
            counted.append((rule, target, checked, passed, empty_score))

    parts = []
    for start in range(0, len(counted), RULES_PER_AGGREGATE):
        parts.append(_counted_rows(df, counted[start:start + RULES_PER_AGGREGATE]))
    if unique:
        parts.append(_unique_rows(df, unique))
    if failed or not parts:
        parts.append(df.sparkSession.createDataFrame(failed, _RULE_ROW))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class _Skip(ValueError):
    """A rule that cannot be evaluated on this table."""


def _column(df: DataFrame, parameters: dict[str, Any], roles: dict[str, str], prefix: str = "target") -> str | None:
    for name in (parameters.get(f"{prefix}_column"), roles.get(parameters.get(f"{prefix}_role"))):
        if name and name in df.columns:
            return name
    return None


def _require(value: Any, reason: str) -> Any:
    if not value:
        raise _Skip(reason)
    return value


def _counters(df: DataFrame, rule: Rule, roles: dict[str, str]) -> tuple[str, Column, Column, float]:
    """Target text, a checked count, a passed count, and the score of an empty check."""
    p = rule.parameters
    if rule.rule_type in ("column_comparison", "cross_field_equality", "cross_field_inequality"):
        left, right = _column(df, p, roles, "left"), _column(df, p, roles, "right")
        _require(left and right, "One or both columns not found")
        target = f"{left}, {right}"
        if rule.rule_type == "column_comparison":
            compare = _require(_OPERATORS.get(p.get("operator", ">=")), "Unsupported operator")
            return target, *_comparison(df, left, right, compare), 1.0
        a, b = as_text(df, left), as_text(df, right)
        both = ~missing(df, left) & ~missing(df, right)
        holds = (a == b) if rule.rule_type == "cross_field_equality" else (a != b)
        return target, F.count_if(both), F.count_if(both & holds), 1.0

    if rule.rule_type == "conditional_required":
        when, need = p.get("condition_column"), p.get("required_column")
        _require(when in df.columns, "Condition column not found")
        _require(need in df.columns, "Required column not found")
        applies = as_text(df, when) == str(p.get("condition_value"))
        return f"{when}, {need}", F.count_if(applies), F.count_if(applies & ~missing(df, need)), 1.0

    name = _require(_column(df, p, roles), "Column not found")
    filled = ~missing(df, name)
    if rule.rule_type == "non_null":
        return name, F.count(F.lit(1)), F.count_if(filled), 0.0
    if rule.rule_type == "expected_unique":
        return name, F.lit(0), F.lit(0), 0.0
    if rule.rule_type == "regex_match":
        pattern = _require(p.get("pattern"), "No pattern specified")
        return name, F.count_if(filled), F.count_if(filled & as_text(df, name).rlike(f"^(?:{pattern})")), 1.0
    if rule.rule_type == "allowed_values":
        allowed = [str(v) for v in p.get("values", [])]
        return name, F.count_if(filled), F.count_if(filled & as_text(df, name).isin(allowed)), 1.0
    if rule.rule_type == "numeric_range":
        return name, *_range(number(df, name), p.get("min_value"), p.get("max_value"),
                             p.get("inclusive_min", True), p.get("inclusive_max", True)), 1.0
    lows = [None if p.get(k) is None else F.lit(str(p[k])).cast("timestamp_ntz") for k in ("min_date", "max_date")]
    return name, *_range(moment(df, name), *lows, True, True), 1.0


def _range(value: Column, low: Any, high: Any, with_low: bool, with_high: bool) -> tuple[Column, Column]:
    ok = value.isNotNull()
    if low is not None:
        ok = ok & ((value >= low) if with_low else (value > low))
    if high is not None:
        ok = ok & ((value <= high) if with_high else (value < high))
    return F.count(value), F.count_if(ok)


def _comparison(df: DataFrame, left: str, right: str, compare) -> tuple[Column, Column]:
    """Numbers, or dates where over half of the left side is no number; decided after one pass."""
    ln, rn, lt, rt = number(df, left), number(df, right), moment(df, left), moment(df, right)
    as_dates = F.count_if(ln.isNull()) > F.count(F.lit(1)) * 0.5
    pick = lambda when_number, when_date: F.when(as_dates, F.count_if(when_date)).otherwise(F.count_if(when_number))
    return (pick(ln.isNotNull() & rn.isNotNull(), lt.isNotNull() & rt.isNotNull()),
            pick(compare(ln, rn), compare(lt, rt)))


def _rule_row(rule: Rule, target: str | Column, checked: Column, passed: Column, empty_score: float) -> list[Column]:
    target = F.lit(target) if isinstance(target, str) else target
    return [
        F.lit(rule.rule_key).alias("rule_key"), F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.source).alias("source"), target.alias("target"),
        checked.alias("records_checked"), passed.alias("pass_count"), (checked - passed).alias("fail_count"),
        F.when(checked > 0, passed / checked).otherwise(empty_score).alias("score"),
        F.lit(None).cast("string").alias("error")]


def _counted_rows(df: DataFrame, rules: list[tuple]) -> DataFrame:
    counters = []
    for i, (_, _, checked, passed, _) in enumerate(rules):
        counters += [checked.alias(f"c{i}"), passed.alias(f"p{i}")]
    structs = [F.struct(*_rule_row(rule, target, F.col(f"c{i}"), F.col(f"p{i}"), empty))
               for i, (rule, target, _, _, empty) in enumerate(rules)]
    return df.agg(*counters).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _unique_rows(df: DataFrame, rules: list[tuple[Rule, str]]) -> DataFrame:
    """Rows beyond the first of each value; nulls are equal to each other here."""
    wanted = df.sparkSession.createDataFrame(
        [(r.rule_key, r.rule_type, r.severity, r.source, c) for r, c in rules],
        "rule_key string, rule_type string, severity string, source string, target string")
    found = hashed_frequencies(df, sorted({c for _, c in rules})).groupBy("column").agg(
        F.sum("copies").alias("n"), F.count(F.lit(1)).alias("d"))
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
    return wanted.join(found, F.col("target") == F.col("column"), "left").select(
        "rule_key", "rule_type", "severity", "source", "target",
        n.alias("records_checked"), d.alias("pass_count"), (n - d).alias("fail_count"),
        F.when(n > 0, d / n).otherwise(0.0).alias("score"), F.lit(None).cast("string").alias("error"))


def mine_invariants(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.99,
                    min_rows: int = 30, max_flag_values: int = 3, top: int | None = 2) -> DataFrame:
    """Order relations between numeric columns that hold on nearly all joint rows.

    ``==``, ``>=`` or ``<=`` per pair; identifier-like names and columns of three or
    fewer distinct values are left out. ``top=None`` returns every relation found.
    """
    names = [c for c in (columns or numeric_columns(df)) if not re.search(V.EXPECTED_UNIQUE_NAME, c)]
    names = _varied(df, names, max_flag_values)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        counters, structs = [], []
        for i, (a, b) in enumerate(pairs[start:start + PAIRS_PER_AGGREGATE]):
            x, y = number(df, a), number(df, b)
            counters += [F.count(x + y).alias(f"n{i}"), F.count_if(x >= y).alias(f"g{i}"), F.count_if(x <= y).alias(f"l{i}")]
            structs.append(F.struct(F.lit(start + i).alias("place"), F.lit(a).alias("left_column"), F.lit(b).alias("right_column"),
                                    F.col(f"n{i}").alias("n"), F.col(f"g{i}").alias("ge"), F.col(f"l{i}").alias("le")))
        parts.append(df.agg(*counters).select(F.explode(F.array(*structs)).alias("p")).select("p.*"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "left_column string, operator string, right_column string, records_checked bigint, holds double, rule_key string")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    ge, le = F.col("ge") / F.col("n"), F.col("le") / F.col("n")
    both = (ge >= threshold) & (le >= threshold)
    operator = F.when(both, "==").when(ge >= threshold, ">=").when(le >= threshold, "<=")
    slug = F.when(F.col("operator") == "==", "eq").when(F.col("operator") == ">=", "ge").otherwise("le")
    out = (
        found.where(F.col("n") >= min_rows)
        .withColumn("operator", operator)
        .withColumn("holds", F.when(both, F.least(ge, le)).when(ge >= threshold, ge).otherwise(le))
        .where(F.col("operator").isNotNull())
        .withColumn("rule_key", F.concat(F.lit("auto_inferred_"), "left_column", F.lit("_"), slug, F.lit("_"), "right_column"))
        .orderBy(F.desc("holds"), "place")
        .select("left_column", "operator", "right_column", F.col("n").alias("records_checked"), "holds", "rule_key")
    )
    return out.limit(top) if top else out


def _varied(df: DataFrame, names: list[str], few: int) -> list[str]:
    """Columns of more than ``few`` distinct numbers.

    A sketch of a few values is all but exact, so columns it puts far above are settled by one
    aggregate; the others have few values and are counted exactly by a second.
    """
    if not names:
        return []
    row = df.agg(*[F.approx_count_distinct(number(df, c), 0.02).alias(f"v{i}") for i, c in enumerate(names)]).first()
    near = [c for i, c in enumerate(names) if row[f"v{i}"] <= 4 * few + 10]
    exact = df.agg(*[F.count_distinct(number(df, c)).alias(f"v{i}") for i, c in enumerate(near)]).first() if near else []
    rare = {c for c, n in zip(near, exact) if n <= few}
    return [c for c in names if c not in rare]


SEVERITY_ORDER = {"critical": 0, "warning": 1, "healthy": 2}


def kpi_alerts(kpis: DataFrame, keys: list[str], rules: list[dict[str, str]]) -> DataFrame:
    """Threshold rules that fire, per row of a KPI table, most severe first.

    Each condition is checked against the allowed language and the table's columns
    and then evaluated by Spark on every row; a rule naming a column the table lacks
    is left out.
    """
    usable = [r for r in rules if names_in(r["condition"]) <= set(kpis.columns)]
    fired = F.array_compact(F.array(*[
        F.when(condition(r["condition"], kpis.columns), F.struct(
            F.lit(r["id"]).alias("rule_id"), F.lit(r["kpi"]).alias("kpi"), F.lit(r["severity"]).alias("severity"),
            F.lit(r["category"]).alias("category"), F.lit(r["interpretation"]).alias("interpretation"),
            F.lit(r["action"]).alias("action")))
        for r in usable]))
    order = F.create_map(*[F.lit(x) for item in SEVERITY_ORDER.items() for x in item])
    return (
        kpis.select(*keys, F.explode(fired).alias("f")).select(*keys, "f.*")
        .orderBy(*keys, order[F.col("severity")], "rule_id")
    )


BEST_LEVELS = ("healthy", "adequate", "immaterial")


def kpi_bands(kpis: DataFrame, keys: list[str], thresholds: dict[str, dict[str, float]],
              higher_is_better: set[str] = frozenset()) -> DataFrame:
    """The band each KPI falls in, with its bound.

    The worst alarm level the value has reached; else the best level where the value
    is within its bound; else ``watch``, the stretch between the two.
    """
    rows = []
    for kpi, levels in thresholds.items():
        if kpi not in kpis.columns:
            continue
        value, up = F.col(f"`{kpi}`"), kpi in higher_is_better
        reached = lambda bound: (value <= bound) if up else (value >= bound)
        alarms = sorted(((n, b) for n, b in levels.items() if n not in BEST_LEVELS),
                        key=lambda item: item[1], reverse=not up)
        tests = [(reached(bound), name, bound) for name, bound in alarms]
        tests += [((value >= bound) if up else (value <= bound), name, bound)
                  for name, bound in levels.items() if name in BEST_LEVELS]
        band, limit = F.when(value.isNotNull(), "watch"), F.lit(None).cast("double")
        for test, name, bound in reversed(tests):
            band, limit = F.when(test, name).otherwise(band), F.when(test, float(bound)).otherwise(limit)
        rows.append(F.struct(F.lit(kpi).alias("kpi"), value.cast("double").alias("value"),
                             band.alias("band"), limit.alias("bound")))
    return kpis.select(*keys, F.explode(F.array(*rows)).alias("b")).select(*keys, "b.*")


def decode_flags(df: DataFrame, flags: dict[str, dict[str, str]]) -> DataFrame:
    """Adds ``<flag>_text`` per known flag column; unknown codes stay as they are."""
    added = {}
    for name, codes in flags.items():
        if name in df.columns:
            lookup = F.create_map(*[F.lit(x) for item in codes.items() for x in item])
            value = F.col(f"`{name}`").cast("string")
            added[f"{name}_text"] = F.coalesce(F.try_element_at(lookup, value), value)
    return df.withColumns(added)
