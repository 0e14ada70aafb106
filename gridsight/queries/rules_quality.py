"""Rules, invariants, KPI alerts, quality dimensions and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsight.operators import kpi, profile, quality, readiness as ready, refine, rules
from gridsight.plans import kpis as K
from gridsight.plans.inputs import CARD, FINANCE, INSURANCE
from gridsight.queries.profiling import PROFILE, card, described
from gridsight.queries.registry import prepared, query, table

SHOWN = ["rule_key", "records_checked", "pass_count", "fail_count", "score"]


def _evaluate(df, *raw):
    return rules.evaluate_rules(df, rules.load_rules(list(raw))).select(*SHOWN)


def _rule_sql(key: str, checked: str, passed: str, source: str, empty: str = "1.0") -> str:
    return (f"SELECT '{key}' AS rule_key, count(*) FILTER ({checked}) AS records_checked, count(*) FILTER (({checked}) AND ({passed})) AS pass_count, "
            f"count(*) FILTER (({checked}) AND NOT COALESCE(({passed}), false)) AS fail_count, "
            f"CASE WHEN count(*) FILTER ({checked}) = 0 THEN {empty} ELSE count(*) FILTER (({checked}) AND ({passed})) / count(*) FILTER ({checked}) END AS score FROM {source}")


CARD_SOURCE = f"({CARD}) c"


@query("rule_non_null", _rule_sql("email_filled", "true", "email IS NOT NULL", CARD_SOURCE, "0.0"))
def rule_non_null(spark, folder):
    return _evaluate(card(spark, folder), {"rule_key": "email_filled", "type": "non_null", "target_column": "email"})


@query("rule_unique", f"""SELECT 'segment_unique' AS rule_key, count(*) AS records_checked, count(DISTINCT COALESCE(segment, '~')) AS pass_count,
 count(*) - count(DISTINCT COALESCE(segment, '~')) AS fail_count, count(DISTINCT COALESCE(segment, '~')) / count(*) AS score FROM {CARD_SOURCE}
 UNION ALL SELECT 'id_unique', count(*), count(DISTINCT customer_id), count(*) - count(DISTINCT customer_id), count(DISTINCT customer_id) / count(*) FROM {CARD_SOURCE}""")
def rule_unique(spark, folder):
    return _evaluate(card(spark, folder), {"rule_key": "segment_unique", "type": "expected_unique", "target_column": "segment"},
                     {"rule_key": "id_unique", "type": "expected_unique", "target_column": "customer_id"})


@query("rule_regex", _rule_sql("email_shape", "email IS NOT NULL", "regexp_matches(email, '^(?:user[0-9]+5@)')", CARD_SOURCE))
def rule_regex(spark, folder):
    return _evaluate(card(spark, folder), {"rule_key": "email_shape", "type": "regex_match", "target_column": "email", "pattern": "user[0-9]+5@"})


@query("rule_allowed_values", _rule_sql("channel_known", "channel IS NOT NULL", "channel IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')", CARD_SOURCE))
def rule_allowed_values(spark, folder):
    return _evaluate(card(spark, folder), {"rule_key": "channel_known", "type": "allowed_values", "target_column": "channel",
                                           "values": ["BUILDING", "AUTOMOBILE", "MACHINERY"]})


@query("rule_range", _rule_sql("balance_range", "account_balance IS NOT NULL", "account_balance > 0 AND account_balance <= 5000", CARD_SOURCE)
       + " UNION ALL " + _rule_sql("code_range", "try_cast(mixed_code AS DOUBLE) IS NOT NULL", "try_cast(mixed_code AS DOUBLE) >= 10", CARD_SOURCE))
def rule_range(spark, folder):
    return _evaluate(card(spark, folder),
                     {"rule_key": "balance_range", "type": "numeric_range", "target_column": "account_balance", "min_value": 0,
                      "inclusive_min": False, "max_value": 5000},
                     {"rule_key": "code_range", "type": "numeric_range", "target_column": "mixed_code", "min_value": 10})


LINES = "(SELECT *, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s"


@query("rule_compare_columns", _rule_sql("ship_after_order", "l_shipdate IS NOT NULL AND o_orderdate IS NOT NULL", "l_shipdate >= o_orderdate", LINES)
       + " UNION ALL " + _rule_sql("price_over_total", "l_extendedprice IS NOT NULL AND o_totalprice IS NOT NULL", "l_extendedprice <= o_totalprice", LINES))
def rule_compare_columns(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _evaluate(lines,
                     {"rule_key": "ship_after_order", "type": "column_comparison", "left_column": "l_shipdate", "operator": ">=", "right_column": "o_orderdate"},
                     {"rule_key": "price_over_total", "type": "column_comparison", "left_column": "l_extendedprice", "operator": "<=", "right_column": "o_totalprice"})


@query("rule_conditional_required", _rule_sql("usd_needs_segment", "currency = 'USD'", "segment IS NOT NULL", CARD_SOURCE))
def rule_conditional_required(spark, folder):
    return _evaluate(card(spark, folder), {"rule_key": "usd_needs_segment", "type": "conditional_required", "condition_column": "currency",
                                           "condition_value": "USD", "required_column": "segment"})


@query("rule_date_range", _rule_sql("order_dates", "o_orderdate IS NOT NULL", "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'", "orders"))
def rule_date_range(spark, folder):
    return _evaluate(table(spark, folder, "orders"), {"rule_key": "order_dates", "type": "date_range", "target_column": "o_orderdate",
                                                      "min_date": "1996-01-01", "max_date": "1998-12-31"})


@query("rule_cross_field", _rule_sql("channel_is_segment", "channel IS NOT NULL AND segment IS NOT NULL", "channel = segment", CARD_SOURCE)
       + " UNION ALL " + _rule_sql("country_not_currency", "country IS NOT NULL AND currency IS NOT NULL", "country <> currency", CARD_SOURCE))
def rule_cross_field(spark, folder):
    return _evaluate(card(spark, folder),
                     {"rule_key": "channel_is_segment", "type": "cross_field_equality", "left_column": "channel", "right_column": "segment"},
                     {"rule_key": "country_not_currency", "type": "cross_field_inequality", "left_column": "country", "right_column": "currency"})


SUITE = [
    {"rule_key": "id_unique", "type": "expected_unique", "target_column": "customer_id"},
    {"rule_key": "email_filled", "type": "non_null", "target_column": "email", "severity": "high"},
    {"rule_key": "email_shape", "type": "regex_match", "target_column": "email", "pattern": r"user[0-9]+@"},
    {"rule_key": "balance_range", "type": "numeric_range", "target_column": "account_balance", "min_value": 0},
    {"rule_key": "channel_known", "type": "allowed_values", "target_column": "channel", "values": ["BUILDING", "AUTOMOBILE", "MACHINERY"]},
    {"rule_key": "channel_is_segment", "type": "cross_field_equality", "left_column": "channel", "right_column": "segment"},
    {"rule_key": "no_such_column", "type": "non_null", "target_column": "fax"},
    {"rule_key": "switched_off", "type": "non_null", "target_column": "email", "active": False},
    {"rule_key": "unknown_type", "type": "phase_of_moon"},
]
SUITE_SQL = "\nUNION ALL ".join([
    f"""SELECT 'id_unique' AS rule_key, 'expected_unique' AS rule_type, count(*) AS records_checked, count(DISTINCT customer_id) AS pass_count,
 count(*) - count(DISTINCT customer_id) AS fail_count, count(DISTINCT customer_id) / count(*) AS score, CAST(NULL AS VARCHAR) AS error FROM {CARD_SOURCE}""",
    *[f"SELECT rule_key, '{t}', records_checked, pass_count, fail_count, score, NULL FROM ({_rule_sql(k, c, p, CARD_SOURCE, e)}) r" for k, t, c, p, e in [
        ("email_filled", "non_null", "true", "email IS NOT NULL", "0.0"),
        ("email_shape", "regex_match", "email IS NOT NULL", "regexp_matches(email, '^(?:user[0-9]+@)')", "1.0"),
        ("balance_range", "numeric_range", "account_balance IS NOT NULL", "account_balance >= 0", "1.0"),
        ("channel_known", "allowed_values", "channel IS NOT NULL", "channel IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')", "1.0"),
        ("channel_is_segment", "cross_field_equality", "channel IS NOT NULL AND segment IS NOT NULL", "channel = segment", "1.0")]],
    "SELECT 'no_such_column', 'non_null', 0, 0, 0, 0.0, 'Column not found'",
    f"SELECT rule_key, 'numeric_range', records_checked, pass_count, fail_count, score, NULL FROM ({_rule_sql('premium_positive', 'account_balance IS NOT NULL', 'account_balance >= 0', CARD_SOURCE)}) r",
    "SELECT 'claims_non_negative', 'numeric_range', 0, 0, 0, 0.0, 'Column not found'",
])


def _suite(spark, folder):
    every = rules.load_rules(SUITE) + rules.domain_rules("insurance")
    return rules.evaluate_rules(card(spark, folder), every, {"premium_amount": "account_balance"})


@query("rule_suite", SUITE_SQL)
def rule_suite(spark, folder):
    return _suite(spark, folder).select("rule_key", "rule_type", *SHOWN[1:], "error")


NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]


def _invariant_sql() -> str:
    parts, place = [], 0
    for i, a in enumerate(NUMERIC):
        for b in NUMERIC[i + 1:]:
            parts.append(f"SELECT {place} AS place, '{a}' AS left_column, '{b}' AS right_column, count(*) AS n, count(*) FILTER ({a} >= {b}) / count(*) AS ge, "
                         f"count(*) FILTER ({a} <= {b}) / count(*) AS le FROM s WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
            place += 1
    return ("WITH s AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (" + " UNION ALL ".join(parts) + """)
SELECT left_column, CASE WHEN ge >= 0.99 AND le >= 0.99 THEN '==' WHEN ge >= 0.99 THEN '>=' ELSE '<=' END AS operator, right_column, n AS records_checked,
 CASE WHEN ge >= 0.99 AND le >= 0.99 THEN least(ge, le) WHEN ge >= 0.99 THEN ge ELSE le END AS holds,
 'auto_inferred_' || left_column || '_' || CASE WHEN ge >= 0.99 AND le >= 0.99 THEN 'eq' WHEN ge >= 0.99 THEN 'ge' ELSE 'le' END || '_' || right_column AS rule_key
FROM p WHERE n >= 30 AND (ge >= 0.99 OR le >= 0.99)""")


@query("mine_invariants", _invariant_sql())
def mine_invariants(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rules.mine_invariants(lines, NUMERIC, top=None)


# --- KPI alerts and bands on insurance ratios per country --------------------------

RATIOS = f"""WITH v AS ({INSURANCE}), g AS (SELECT country, sum(gross_written_premium) AS gwp, sum(earned_premium) - sum(reinsurance_earned_premium) AS nep,
 sum(gross_claims_incurred) - sum(reinsurance_recovery) AS nci, sum(acquisition_expense) AS acq, sum(claims_handling_expense) AS che, sum(administrative_expense) AS adm,
 sum(claims_reported_count) AS reported, sum(policies_in_force) AS force, sum(claims_paid_amount) AS paid, sum(claims_approved_count) AS approved,
 sum(renewed_policy_count) AS renewed, sum(renewal_due_policy_count) AS due, sum(lapsed_policy_count) AS lapsed, sum(outstanding_claim_reserve) AS ocr,
 sum(ibnr_reserve) AS ibnr, sum(premium_collected) AS collected, sum(ceded_reinsurance_premium) AS ceded FROM v GROUP BY country),
k AS (SELECT country, gwp - ceded AS net_written_premium, nep AS net_earned_premium, nci AS net_claims_incurred, nep - nci - acq - che - adm AS underwriting_result,
 nci / nep * 100 AS loss_ratio, (acq + adm) / nep * 100 AS expense_ratio, nci / nep * 100 + (acq + adm) / nep * 100 AS combined_ratio,
 reported / force AS claim_frequency, paid / NULLIF(approved, 0) AS average_claim_severity, renewed / due * 100 AS renewal_rate,
 lapsed / force * 100 AS policy_lapse_rate, (ocr + ibnr) / nci AS reserve_adequacy_ratio, collected / gwp * 100 AS premium_collection_rate FROM g)"""
RATIO_NAMES = list(K.FORMULAS["insurance"])


def _ratios(spark, folder, keys=("country",)):
    return kpi.kpi_ratios(prepared(spark, folder, INSURANCE), K.FORMULAS["insurance"], list(keys))


@query("kpi_ratio_suite", f"{RATIOS} SELECT country, " + ", ".join(f"round({n}, 4) AS {n}" for n in RATIO_NAMES) + " FROM k")
def kpi_ratio_suite(spark, folder):
    return _ratios(spark, folder).select("country", *[F.round(n, 4).alias(n) for n in RATIO_NAMES])


ALERTABLE = [r for r in K.ALERT_RULES if r["kpi"] in RATIO_NAMES]


@query("kpi_rule_alerts", f"{RATIOS}, a AS (SELECT country, " + ", ".join(f"{n} AS {n}_actual" for n in RATIO_NAMES) + " FROM k)\n" + "\nUNION ALL ".join(
    f"SELECT country, '{r['id']}' AS rule_id, '{r['kpi']}' AS kpi, '{r['severity']}' AS severity FROM a WHERE {r['condition']}" for r in ALERTABLE))
def kpi_rule_alerts(spark, folder):
    actual = _ratios(spark, folder).withColumnsRenamed({n: f"{n}_actual" for n in RATIO_NAMES})
    return rules.kpi_alerts(actual, ["country"], K.ALERT_RULES).select("country", "rule_id", "kpi", "severity")


def _band_sql(name: str) -> str:
    up, levels = name in K.HIGHER_IS_BETTER, K.THRESHOLDS[name]
    alarms = sorted(((n, b) for n, b in levels.items() if n not in rules.BEST_LEVELS), key=lambda i: i[1], reverse=not up)
    best = [(n, b) for n, b in levels.items() if n in rules.BEST_LEVELS]
    tests = [(f"{name} {'<=' if up else '>='} {b}", n, b) for n, b in alarms] + [(f"{name} {'>=' if up else '<='} {b}", n, b) for n, b in best]
    band = " ".join(f"WHEN {t} THEN '{n}'" for t, n, _ in tests)
    bound = " ".join(f"WHEN {t} THEN {float(b)}" for t, _, b in tests)
    return f"SELECT country, '{name}' AS kpi, round({name}, 6) AS value, CASE {band} ELSE 'watch' END AS band, CASE {bound} END AS bound FROM k"


@query("kpi_bands", f"{RATIOS} " + " UNION ALL ".join(_band_sql(n) for n in K.THRESHOLDS if n in RATIO_NAMES))
def kpi_bands(spark, folder):
    return rules.kpi_bands(_ratios(spark, folder), ["country"], K.THRESHOLDS, K.HIGHER_IS_BETTER).withColumn("value", F.round("value", 6))


@query("decode_flags", f"""SELECT structural_vs_timing_flag, recurring_flag, count(*) AS lines,
 CASE structural_vs_timing_flag WHEN 'S' THEN 'Structural' WHEN 'T' THEN 'Timing' END AS structural_vs_timing_flag_text,
 CASE recurring_flag WHEN 'Y' THEN 'Recurring' WHEN 'N' THEN 'Non-Recurring' END AS recurring_flag_text FROM ({FINANCE}) f
 GROUP BY structural_vs_timing_flag, recurring_flag""")
def decode_flags(spark, folder):
    decoded = rules.decode_flags(prepared(spark, folder, FINANCE), K.FLAG_CODES)
    return decoded.groupBy("structural_vs_timing_flag", "recurring_flag", "structural_vs_timing_flag_text", "recurring_flag_text").agg(F.count("*").alias("lines"))


# --- Quality and readiness ---------------------------------------------------------

CONFIDENCES = {"schema_intelligence_confidence": 0.8, "column_classification_confidence": 0.7, "hierarchy_confidence": 0.95}


def _dimensions(spark, folder):
    counts = profile.column_counts(card(spark, folder)).withColumn("normalized_key", F.col("column"))
    return quality.quality_dimensions(counts, _suite(spark, folder), mandatory=["email", "segment", "currency"], unique=["customer_id", "contact"],
                                      confidences=CONFIDENCES)


SEMANTIC = "(0.30 * 0.8 + 0.25 * 0.7 + 0.20 * 0.95) / 0.75"
DIMENSIONS = f"""WITH r AS ({SUITE_SQL}), c AS ({CARD}),
d AS (SELECT 'completeness' AS dimension, 1 - (3 * count(*) - count(email) - count(segment) - count(currency)) / (3 * count(*)) AS score, 3 * count(*) AS assessed_count,
 3 * count(*) - count(email) - count(segment) - count(currency) AS violation_count FROM c
 UNION ALL SELECT 'uniqueness', 1 - (count(customer_id) - count(DISTINCT customer_id) + count(contact) - count(DISTINCT contact)) / (2 * count(*)), 2 * count(*),
 count(customer_id) - count(DISTINCT customer_id) + count(contact) - count(DISTINCT contact) FROM c
 UNION ALL SELECT 'validity', 1 - sum(fail_count) / sum(records_checked), sum(records_checked), sum(fail_count) FROM r WHERE error IS NULL AND rule_type IN ('numeric_range', 'allowed_values', 'date_range')
 UNION ALL SELECT 'conformity', 1 - sum(fail_count) / sum(records_checked), sum(records_checked), sum(fail_count) FROM r WHERE error IS NULL AND rule_type = 'regex_match'
 UNION ALL SELECT 'consistency', 1 - sum(fail_count) / sum(records_checked), sum(records_checked), sum(fail_count) FROM r WHERE error IS NULL AND rule_type LIKE 'cross_field%'
 UNION ALL SELECT 'business_rule_compliance', 1 - sum(fail_count) / sum(records_checked), sum(records_checked), sum(fail_count) FROM r WHERE error IS NULL AND records_checked > 0
 UNION ALL SELECT 'timeliness', NULL, 0, 0 UNION ALL SELECT 'integrity', NULL, 0, 0 UNION ALL SELECT 'accuracy', NULL, 0, 0
 UNION ALL SELECT 'semantic_quality', {SEMANTIC}, 3, 0)"""


@query("quality_dimensions", f"""{DIMENSIONS} SELECT dimension, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'not_assessable' ELSE 'assessed' END AS status,
 assessed_count, violation_count FROM d""")
def quality_dimensions(spark, folder):
    return _dimensions(spark, folder).withColumn("score", F.round("score", 6))


WEIGHT = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in quality.WEIGHTS.items()) + " END"


@query("overall_quality", f"""{DIMENSIONS}, w AS (SELECT *, {WEIGHT} AS weight FROM d)
SELECT round(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL), 4) AS overall_score,
 round(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL) * 100, 2) AS display_score, count(score) AS assessed_dimensions, count(*) - count(score) AS excluded_dimensions FROM w""")
def overall_quality(spark, folder):
    return quality.overall_quality(_dimensions(spark, folder))


@query("ref_integrity", """SELECT count(o_custkey) AS records_checked, count(o_custkey) FILTER (c.k IS NULL) AS fail_count, count(DISTINCT o_custkey) FILTER (c.k IS NULL) AS missing_keys,
 1 - count(o_custkey) FILTER (c.k IS NULL) / count(o_custkey) AS score FROM orders LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.k""")
def ref_integrity(spark, folder):
    known = table(spark, folder, "customer").where(F.col("c_acctbal") > 0)
    return quality.reference_integrity(table(spark, folder, "orders"), "o_custkey", known, "c_custkey")


@query("freshness", """SELECT max(o_orderdate) AS newest, date_diff('day', max(o_orderdate), TIMESTAMP '2002-01-01') AS age_days,
 CASE WHEN date_diff('day', max(o_orderdate), TIMESTAMP '2002-01-01') <= 400 THEN 1.0 ELSE 0.0 END AS score FROM orders""")
def freshness(spark, folder):
    return quality.freshness(table(spark, folder, "orders"), "o_orderdate", "2002-01-01", 400)


# The roles the card's columns get, fixed by their names and types.
ROLES = """CASE WHEN identifier_score >= 0.6 AND cardinality_ratio >= 0.98 THEN 'identifier' WHEN refined_type IN ('date', 'datetime') THEN 'temporal_dimension'
 WHEN refined_type = 'boolean' THEN 'flag' WHEN refined_type IN ('email', 'phone', 'currency_code', 'country_code') THEN 'dimension' WHEN refined_type = 'percentage' THEN 'metric'
 WHEN refined_type IN ('integer', 'decimal') AND regexp_matches("column", 'amount|amt|price|revenue|cost|total|balance|count') THEN 'metric'
 WHEN refined_type IN ('integer', 'decimal') AND cardinality_ratio <= 0.05 AND distinct_count <= 20 THEN 'dimension' WHEN refined_type IN ('integer', 'decimal') THEN 'metric'
 WHEN refined_type IN ('categorical', 'text') AND regexp_matches("column", 'note|desc') THEN 'text_field' WHEN refined_type = 'categorical' THEN 'dimension'
 WHEN refined_type = 'text' AND regexp_matches("column", 'name|title|label') THEN 'dimension' WHEN refined_type = 'text' THEN 'text_field' ELSE 'unknown' END"""
# PROFILE opens its own WITH list; the dimensions join it as further members.
_D = DIMENSIONS.replace("WITH r AS", "r AS", 1).replace(f"c AS ({CARD})", "c AS (SELECT * FROM card)")
READINESS = f"""{PROFILE}, {_D}, roles AS (SELECT *, identifier_score >= 0.6 AND cardinality_ratio >= 0.98 AS grain, {ROLES} AS role FROM scored),
s AS (SELECT count(*) AS n, max(row_count) AS n_rows, count(*) FILTER (role = 'metric') AS metrics, count(*) FILTER (role = 'dimension') AS dims,
 count(*) FILTER (role = 'temporal_dimension') AS temporal, count(*) FILTER (grain) AS grain, count(*) FILTER (NOT grain AND cardinality_ratio > 0.9) AS wide, avg(null_ratio) AS nulls,
 (SELECT score FROM d WHERE dimension = 'completeness') AS comp, (SELECT score FROM d WHERE dimension = 'validity') AS val, (SELECT score FROM d WHERE dimension = 'consistency') AS con,
 (SELECT score FROM d WHERE dimension = 'uniqueness') AS uni, (SELECT score FROM d WHERE dimension = 'semantic_quality') AS sem FROM roles),
pts AS (SELECT comp * 20 + val * 15 + con * 15 + CASE WHEN metrics >= 2 THEN 15 WHEN metrics >= 1 THEN 8 ELSE 0 END + CASE WHEN dims >= 3 THEN 15 WHEN dims >= 1 THEN 8 ELSE 0 END
  + CASE WHEN grain > 0 THEN 10 ELSE 0 END + CASE WHEN temporal > 0 THEN 10 ELSE 0 END AS analytics,
 comp * 20 + con * 15 + (n - grain) / n * 15 + CASE WHEN n_rows >= 10000 THEN 15 WHEN n_rows >= 1000 THEN 10 WHEN n_rows >= 100 THEN 5 ELSE 0 END + CASE WHEN wide = 0 THEN 10 ELSE 5 END + uni * 10 AS ml,
 15 + sem * 20 + (1 - nulls) * 15 + 15 + 10 + 0.6 * 15 AS llm FROM s),
q AS (SELECT analytics, ml, llm, ml / (20 + 15 + 15 + 15 + 10 + 10) * 100 AS ml_dataset FROM pts),
t AS (SELECT 'analytics' AS assessment, analytics AS score, analytics AS dataset_score FROM q UNION ALL SELECT 'ml', ml, ml_dataset FROM q
 UNION ALL SELECT 'llm', llm, llm FROM q UNION ALL SELECT 'overall', (analytics + ml + llm) / 3, (analytics + ml_dataset + llm) / 3 FROM q)
SELECT assessment, round(score, 2) AS score, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 60 THEN 'partially_ready' ELSE 'not_ready' END AS status,
 round(dataset_score, 2) AS dataset_score, CAST(NULL AS DOUBLE) AS task_score FROM t"""


@query("readiness", READINESS)
def readiness(spark, folder):
    return ready.readiness(described(spark, folder), _dimensions(spark, folder), description_coverage=0.6)


@query("readiness_with_features")
def readiness_with_features(spark, folder):
    roles = described(spark, folder)
    features = refine.feature_split(roles).where(F.col("decision") == "keep").select("column", "usefulness")
    return ready.readiness(roles, _dimensions(spark, folder), description_coverage=0.9, features=features, approach_confidence=0.7)
