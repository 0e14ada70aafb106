"""Quality gate and profile queries on the customer card."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsight.functions.parsing import BOOLEAN_TOKENS, PLACEHOLDERS
from gridsight.operators import gate, profile, refine
from gridsight.plans import vocabulary as V
from gridsight.plans.inputs import CARD
from gridsight.queries.registry import prepared, query, table

CARD_KINDS = {
    "customer_id": "number", "customer_name": "text", "email": "text", "contact": "text", "segment": "text",
    "channel": "text", "currency": "text", "country": "text", "active_flag": "text", "created_date": "text",
    "mixed_code": "text", "account_balance": "number", "discount_rate": "number", "nation_no": "number", "notes": "text",
}


def cells_sql(columns: dict[str, str], source: str) -> str:
    parts = [f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS native, CAST({c} AS VARCHAR) AS value FROM {source}"
             for i, (c, k) in enumerate(columns.items())]
    return "\nUNION ALL ".join(parts)


NUMBER = r"regexp_matches(value, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$')"
TIME = (r"(regexp_matches(value, '^\s*[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2}([T ][0-9].*)?)?\s*$') AND try_cast(value AS TIMESTAMP) IS NOT NULL)")
BOOLEAN = "lower(trim(value)) IN (" + ", ".join(f"'{t}'" for t in BOOLEAN_TOKENS) + ")"
HOLDERS = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
WORDS = r"CASE WHEN trim(value) = '' THEN 0 ELSE len(regexp_split_to_array(trim(value), '\s+')) END"
CASING = r"""CASE WHEN native <> 'text' OR value IS NULL OR trim(value) = '' THEN NULL
 WHEN regexp_matches(value, '[A-Za-z]') AND upper(value) = value THEN 'upper'
 WHEN regexp_matches(value, '[A-Za-z]') AND lower(value) = value THEN 'lower'
 WHEN regexp_matches(value, '^[^A-Za-z]*[A-Z][a-z]*([^A-Za-z]+[A-Z][a-z]*)*[^A-Za-z]*$') THEN 'title' ELSE 'mixed' END"""
KIND = f"""CASE WHEN value IS NULL THEN NULL WHEN native <> 'text' THEN native WHEN {NUMBER} THEN 'number'
 WHEN lower(trim(value)) IN ('true', 'false') THEN 'boolean' WHEN {TIME} THEN 'time' ELSE 'text' END"""

CELLS = f"WITH card AS ({CARD}), cells AS ({cells_sql(CARD_KINDS, 'card')})"
CHECKS = f"""{CELLS}, checks AS (SELECT "column", count(*) AS n_rows, count(value) AS filled,
 count(*) FILTER (kind = 'boolean') AS as_boolean, count(*) FILTER (kind = 'number') AS as_number,
 count(*) FILTER (kind = 'time') AS as_time, count(*) FILTER (kind = 'text') AS as_text,
 count(*) FILTER (lower(trim(value)) IN ({HOLDERS})) AS placeholders,
 count(value) FILTER (native = 'text') AS strings, avg(words) FILTER (native = 'text') AS mean_words,
 avg(length(value)) FILTER (native = 'text') AS mean_length, stddev_pop(length(value)) FILTER (native = 'text') AS sd_length,
 count(casing) AS solid_strings, avg(words) FILTER (casing IS NOT NULL) AS solid_mean_words,
 avg(length(value)) FILTER (casing IS NOT NULL) AS solid_mean_length,
 count(*) FILTER (casing = 'upper') AS case_upper, count(*) FILTER (casing = 'lower') AS case_lower,
 count(*) FILTER (casing = 'title') AS case_title, count(*) FILTER (casing = 'mixed') AS case_mixed
 FROM (SELECT *, {KIND} AS kind, {CASING} AS casing, {WORDS} AS words FROM cells) c GROUP BY "column")"""
LENGTHS = f"""{CHECKS}, lengths AS (SELECT c."column",
 max(CASE WHEN k.strings >= 3 AND NOT (mean_words >= 4 OR mean_length >= 40) THEN strings ELSE 0 END) AS length_checked,
 count(*) FILTER (k.strings >= 3 AND NOT (mean_words >= 4 OR mean_length >= 40) AND c.native = 'text' AND sd_length > 0
   AND abs(length(c.value) - mean_length) > 3 * sd_length) AS length_outliers
 FROM cells c JOIN checks k ON c."column" = k."column" GROUP BY c."column")"""
CONSISTENCY = "CASE WHEN filled = 0 THEN 1.0 ELSE greatest(as_boolean, as_number, as_time, as_text) / filled END"


def card(spark, folder):
    return prepared(spark, folder, CARD)


@query("qc_missing_values", f"""{CHECKS} SELECT "column", n_rows AS rows, n_rows - filled AS missing,
 (n_rows - filled) / n_rows AS missing_share FROM checks""")
def qc_missing_values(spark, folder):
    return gate.missing_values(gate.column_checks(card(spark, folder)))


@query("qc_duplicate_rows", """SELECT (SELECT count(*) FROM lineitem) AS rows,
 (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_quantity, l_discount, l_tax, l_shipdate FROM lineitem) d) AS duplicates""")
def qc_duplicate_rows(spark, folder):
    return gate.duplicate_rows(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_shipdate"))


@query("qc_empty_columns", f"""{CELLS}, more AS (SELECT * FROM cells UNION ALL SELECT 15, 'fax', 'text', NULL FROM card)
 SELECT "column", count(*) AS rows, count(value) AS filled FROM more GROUP BY "column" HAVING count(value) = 0""")
def qc_empty_columns(spark, folder):
    with_gap = card(spark, folder).withColumn("fax", F.lit(None).cast("string"))
    return gate.column_checks(with_gap).where(F.col("filled") == 0).select("column", "rows", "filled")


@query("qc_type_consistency", f"""{CHECKS} SELECT "column", filled, as_boolean, as_number, as_time, as_text, {CONSISTENCY} AS consistency FROM checks""")
def qc_type_consistency(spark, folder):
    return gate.type_consistency(gate.column_checks(card(spark, folder)))


@query("qc_placeholders", f"""{CHECKS} SELECT "column", filled, placeholders FROM checks WHERE placeholders > 0""")
def qc_placeholders(spark, folder):
    return gate.column_checks(card(spark, folder)).where(F.col("placeholders") > 0).select("column", "filled", "placeholders")


@query("qc_null_heavy_rows", f"""WITH card AS ({CARD}) SELECT count(*) AS rows, count(*) FILTER (
 (CASE WHEN email IS NULL THEN 1 ELSE 0 END + CASE WHEN segment IS NULL THEN 1 ELSE 0 END + CASE WHEN notes IS NULL THEN 1 ELSE 0 END) / 3.0 * 100 > 50)
 AS null_heavy FROM card""")
def qc_null_heavy_rows(spark, folder):
    return gate.null_heavy_rows(card(spark, folder).select("email", "segment", "notes"))


@query("qc_length_outliers", f"""{LENGTHS} SELECT "column", length_checked, length_outliers FROM lengths WHERE length_checked > 0""")
def qc_length_outliers(spark, folder):
    source = card(spark, folder)
    return gate.length_outliers(source, gate.column_checks(source)).where(F.col("length_checked") > 0).select(
        "column", "length_checked", "length_outliers")


@query("qc_casing", f"""{CHECKS} SELECT "column", solid_strings, case_upper, case_lower, case_title, case_mixed,
 greatest(case_upper, case_lower, case_title, case_mixed) / solid_strings AS consistency FROM checks
 WHERE solid_strings > 0 AND NOT (solid_mean_words >= 4 OR solid_mean_length >= 40)""")
def qc_casing(spark, folder):
    return gate.casing_consistency(gate.column_checks(card(spark, folder)))


@query("quality_gate", f"""{LENGTHS}, heavy AS (SELECT count(*) AS n, count(*) FILTER ((""" + " + ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in CARD_KINDS) + f""") / 15.0 * 100 > 50) AS null_heavy FROM card),
copies AS (SELECT (SELECT count(*) FROM card) - (SELECT count(*) FROM (SELECT DISTINCT * FROM card) d) AS duplicates),
one AS (SELECT sum(n_rows - filled) / sum(n_rows) AS holes, max((n_rows - filled) / n_rows) AS worst, count(*) FILTER (filled = 0) / 15 AS empty,
 sum(placeholders) / sum(filled) AS placeholders, avg({CONSISTENCY}) AS typed,
 avg(CASE WHEN solid_strings > 0 AND NOT (solid_mean_words >= 4 OR solid_mean_length >= 40)
   THEN greatest(case_upper, case_lower, case_title, case_mixed) / solid_strings END) AS cased,
 (SELECT sum(length_outliers) / sum(length_checked) FROM lengths) AS long_cells,
 (SELECT null_heavy / n FROM heavy) AS heavy, (SELECT duplicates / (SELECT n FROM heavy) FROM copies) AS copies FROM checks),
rows_ AS (SELECT 0 AS position, 'column_count' AS "check", 15.0 AS weight, 1.0 AS part FROM one
 UNION ALL SELECT 1, 'missing_values', 20.0, 1 - greatest(holes, worst) FROM one
 UNION ALL SELECT 2, 'duplicate_columns', 5.0, 1.0 FROM one
 UNION ALL SELECT 3, 'duplicate_rows', 5.0, 1 - copies FROM one
 UNION ALL SELECT 4, 'empty_columns', 10.0, 1 - empty FROM one
 UNION ALL SELECT 5, 'datatype_consistency', 15.0, typed FROM one
 UNION ALL SELECT 6, 'corrupted_values', 10.0, 1 - placeholders FROM one
 UNION ALL SELECT 7, 'null_heavy_rows', 10.0, 1 - heavy FROM one
 UNION ALL SELECT 8, 'cell_length_outliers', 5.0, 1 - long_cells FROM one
 UNION ALL SELECT 9, 'mixed_formats', 5.0, cased FROM one)
SELECT position, "check", weight, round(weight * part, 2) AS score, (SELECT round(sum(weight * part), 2) FROM rows_) AS dataset_score,
 (SELECT CASE WHEN sum(weight * part) >= 75 THEN 'PASS' ELSE 'FAIL' END FROM rows_) AS decision, (SELECT n FROM heavy) AS rows_analyzed FROM rows_""")
def quality_gate(spark, folder):
    return gate.quality_gate(card(spark, folder)).drop("warning")


@query("dataset_profile", f"""{CELLS} SELECT (SELECT count(*) FROM card) AS row_count, 15 AS column_count,
 (SELECT count(*) FROM card) - (SELECT count(*) FROM (SELECT DISTINCT * FROM card) d) AS duplicate_row_count,
 (SELECT sum(strlen(value)) FROM cells) AS text_bytes, '{' '.join(CARD_KINDS)}' AS normalized_keys, '' AS duplicate_column_names""")
def dataset_profile(spark, folder):
    return profile.dataset_profile(card(spark, folder)).withColumns({
        "normalized_keys": F.array_join("normalized_keys", " "), "duplicate_column_names": F.array_join("duplicate_column_names", " ")})


COUNTS = f"""{CELLS}, counts AS (SELECT position, "column", count(*) AS row_count, count(value) AS non_null_count, count(*) - count(value) AS null_count,
 (count(*) - count(value)) / count(*) AS null_ratio, count(DISTINCT value) AS distinct_count,
 count(DISTINCT value) / count(value) AS cardinality_ratio, count(value) - count(DISTINCT value) AS duplicate_count FROM cells GROUP BY position, "column")"""


@query("column_profile_counts", f"""{COUNTS} SELECT "column", row_count, non_null_count, null_count, null_ratio, distinct_count, cardinality_ratio, duplicate_count,
 concat_ws('; ', CASE WHEN null_ratio > 0.5 THEN 'high null ratio' END, CASE WHEN cardinality_ratio > 0.98 AND non_null_count > 10 THEN 'near-unique column' END) AS warning
 FROM counts""")
def column_profile_counts(spark, folder):
    return profile.column_counts(card(spark, folder))


@query("column_profile_numeric", """WITH x AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem
 UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem
 UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT "column", count(x) AS numeric_count, min(x) AS min_value, max(x) AS max_value, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median,
 round(stddev_samp(x), 6) AS std_dev, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75,
 bool_and(x % 1 = 0) AS all_integer_valued FROM x GROUP BY "column" """)
def column_profile_numeric(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_linenumber", "l_tax", "l_returnflag")
    out = profile.column_numbers(lines)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std_dev", "q25", "q50", "q75")})


@query("column_profile_strings", """WITH c AS (SELECT 'text' AS "column", text AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents
 UNION ALL SELECT 'source', source FROM documents)
SELECT "column", min(length(value)) AS min_string_length, max(length(value)) AS max_string_length, round(avg(length(value)), 6) AS avg_string_length
FROM c GROUP BY "column" """)
def column_profile_strings(spark, folder):
    out = profile.column_strings(table(spark, folder, "documents"), ["text", "lang", "source"])
    return out.withColumn("avg_string_length", F.round("avg_string_length", 6))


@query("parse_ratios", f"""{CELLS} SELECT "column", count(*) FILTER ({NUMBER}) / count(value) AS numeric_parse_ratio,
 count(*) FILTER ({TIME}) / count(value) AS datetime_parse_ratio, count(*) FILTER ({BOOLEAN}) / count(value) AS boolean_parse_ratio
 FROM cells GROUP BY "column" """)
def parse_ratios(spark, folder):
    return profile.parse_ratios(card(spark, folder))


def _pattern_sql(label: str, pattern: str) -> str:
    if label == "PHONE":
        return r"regexp_matches(value, '^\+?\d[\d\s\-\(\)]{7,}$') AND regexp_matches(value, '[\s\-\(\)+]')"
    return f"regexp_matches(value, '{pattern}')"


PATTERN_ROWS = "\nUNION ALL ".join(
    f"""SELECT "column", {i} AS position, '{label}' AS pattern, count(*) FILTER ({_pattern_sql(label, p)}) AS matches, count(value) AS filled FROM cells GROUP BY "column" """
    for i, (label, p) in enumerate(profile.PATTERNS.items()))


@query("dominant_patterns", f"""{CELLS}, p AS ({PATTERN_ROWS}),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY matches DESC, position) AS rank FROM p WHERE matches > 0.5 * filled)
 SELECT "column", pattern, matches, matches / filled AS ratio, rank FROM r WHERE rank <= 5""")
def dominant_patterns(spark, folder):
    return profile.pattern_counts(card(spark, folder))


@query("representative_values", f"""{CELLS}, f AS (SELECT "column", value, count(*) AS copies FROM cells WHERE value IS NOT NULL GROUP BY "column", value),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY copies DESC, value) AS rank FROM f) SELECT "column", value, copies, rank FROM r WHERE rank <= 10""")
def representative_values(spark, folder):
    return profile.representative_values(card(spark, folder))


@query("sample_values", """WITH c AS (SELECT 'p_name' AS "column", p_name AS value, p_partkey AS k FROM part UNION ALL SELECT 'p_type', p_type, p_partkey FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY k) AS rank FROM c WHERE value IS NOT NULL) SELECT "column", value, rank FROM r WHERE rank <= 10""")
def sample_values(spark, folder):
    return profile.sample_values(table(spark, folder, "part"), ["p_partkey"], ["p_name", "p_type"])


# --- Decision lists over the profile, restated in SQL from the raw cells -----------

def _codes(codes: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


TOPS = """tops AS (SELECT "column", list(value ORDER BY rank) AS reps FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY copies DESC, value) AS rank
 FROM (SELECT "column", value, count(*) AS copies FROM cells WHERE value IS NOT NULL GROUP BY "column", value) f) r WHERE rank <= 10 GROUP BY "column")"""
PROFILE = f"""{COUNTS}, {TOPS}, texts AS (SELECT "column", min(length(value)) AS lo, max(length(value)) AS hi, avg(length(value)) AS mean_length,
 count(*) FILTER ({NUMBER}) / count(value) AS num, count(*) FILTER ({TIME}) / count(value) AS tim, count(*) FILTER ({BOOLEAN}) / count(value) AS boo,
 min(CASE WHEN {NUMBER} THEN CAST(value AS DOUBLE) END) AS min_value, max(CASE WHEN {NUMBER} THEN CAST(value AS DOUBLE) END) AS max_value,
 bool_and(CASE WHEN {NUMBER} THEN CAST(value AS DOUBLE) % 1 = 0 END) AS whole FROM cells GROUP BY "column"),
p AS (SELECT c.*, t.* EXCLUDE ("column"), tops.reps FROM counts c JOIN texts t ON c."column" = t."column" LEFT JOIN tops ON c."column" = tops."column"),
pat AS ({PATTERN_ROWS}), dom AS (SELECT "column", list(pattern) AS pats FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY matches DESC, position) AS rk
 FROM pat WHERE matches > 0.5 * filled) q WHERE rk <= 5 GROUP BY "column"),
typed AS (SELECT p.*, CASE WHEN non_null_count = 0 THEN 'unknown'
 WHEN (boo >= 0.95 AND distinct_count <= 3) OR (num >= 0.95 AND distinct_count <= 2 AND min_value >= 0 AND max_value <= 1) THEN 'boolean'
 WHEN tim >= 0.9 THEN CASE WHEN list_contains(pats, 'YYYY-MM-DD') OR list_contains(pats, 'DATE_SLASH') THEN 'date' ELSE 'datetime' END
 WHEN list_contains(pats, 'EMAIL') THEN 'email' WHEN list_contains(pats, 'PHONE') THEN 'phone'
 WHEN distinct_count <= 50 AND list_contains(pats, 'THREE_LETTER_CODE') AND len(list_filter(reps, lambda v: upper(v) IN ({_codes(V.CURRENCY_CODES)}))) >= 0.7 * len(reps) THEN 'currency_code'
 WHEN distinct_count <= 250 AND list_contains(pats, 'TWO_LETTER_CODE') AND len(list_filter(reps, lambda v: upper(v) IN ({_codes(V.COUNTRY_CODES_2)}))) >= 0.7 * len(reps) THEN 'country_code'
 WHEN num >= 0.9 AND (COALESCE(min_value >= 0 AND max_value <= 100, false)) AND regexp_matches(p."column", '{V.PERCENT_NAME}') THEN 'percentage'
 WHEN num >= 0.9 THEN CASE WHEN whole THEN 'integer' ELSE 'decimal' END
 WHEN mean_length <= 40 AND cardinality_ratio >= 0.98 AND non_null_count > 10 THEN 'identifier'
 WHEN (cardinality_ratio <= 0.05 AND distinct_count <= 50) OR (distinct_count <= 20 AND non_null_count >= 50) THEN 'categorical' ELSE 'text' END AS refined_type
 FROM p LEFT JOIN dom ON p."column" = dom."column"),
named AS (SELECT *, regexp_matches("column", '{V.IDENTIFIER_NAME}') AS named FROM typed),
scored AS (SELECT *, round(greatest(0, least(1, (CASE WHEN cardinality_ratio >= 0.98 THEN 0.5 WHEN cardinality_ratio >= 0.9 THEN 0.25 ELSE 0 END)
 + (CASE WHEN null_ratio <= 0.01 THEN 0.1 WHEN null_ratio > 0.1 THEN -0.15 ELSE 0 END) + (CASE WHEN duplicate_count = 0 AND non_null_count > 1 THEN 0.15 ELSE 0 END)
 + (CASE WHEN refined_type = 'identifier' THEN 0.1 ELSE 0 END) + (CASE WHEN named THEN 0.05 ELSE 0 END)
 - (CASE WHEN cardinality_ratio < 0.5 AND non_null_count > 10 THEN 0.3 ELSE 0 END) - (CASE WHEN refined_type = 'decimal' AND NOT named THEN 0.4 ELSE 0 END)
 - (CASE WHEN mean_length > 40 AND NOT named THEN 0.4 ELSE 0 END))), 3) AS identifier_score FROM named)"""


@query("refined_types", f"""{PROFILE} SELECT "column", refined_type FROM typed""")
def refined_types(spark, folder):
    return refine.refined_types(profile.column_profiles(card(spark, folder))).select("column", "refined_type")


@query("identifier_scores", f"""{PROFILE} SELECT "column", CAST(identifier_score AS DOUBLE) AS identifier_score,
 identifier_score >= 0.6 AND cardinality_ratio >= 0.98 AS is_identifier FROM scored""")
def identifier_scores(spark, folder):
    return refine.identifier_scores(refine.refined_types(profile.column_profiles(card(spark, folder)))).select(
        "column", "identifier_score", "is_identifier")


def described(spark, folder):
    return refine.described_columns(profile.column_profiles(card(spark, folder)))


def _name_case(rules: list[tuple[str, str]], default: str) -> str:
    tests = " ".join(f"WHEN regexp_matches(\"column\", '{p}') THEN '{t}'" for p, t in rules)
    return f"CASE {tests} ELSE {default} END"


_NAMED = lambda pattern: f"regexp_matches(\"column\", '{pattern}')"
_CASES = [
    ("grain", _name_case(V.IDENTIFIER_KINDS, "'identifier'"), "identifier", 0.90),
    ("refined_type IN ('date', 'datetime')", _name_case(V.DATE_KINDS, "refined_type"), "temporal_dimension", 0.88),
    ("refined_type = 'boolean'", _name_case(V.FLAG_KINDS, "'flag'"), "flag", 0.85),
    ("refined_type = 'email'", "'email_address'", "dimension", 0.92),
    ("refined_type = 'phone'", "'phone_number'", "dimension", 0.88),
    ("refined_type = 'currency_code'", "'currency_code'", "dimension", 0.93),
    ("refined_type = 'country_code'", "'country_code'", "dimension", 0.91),
    ("refined_type = 'percentage'", "'percentage'", "metric", 0.85),
    (f"refined_type IN ('integer', 'decimal') AND {_NAMED(V.METRIC_NAME)}", _name_case(V.METRIC_KINDS, "'monetary_amount'"), "metric", 0.85),
    ("refined_type IN ('integer', 'decimal') AND cardinality_ratio <= 0.05 AND distinct_count <= 20", "'numeric_category'", "dimension", 0.70),
    ("refined_type IN ('integer', 'decimal')", "'numeric_measure'", "metric", 0.65),
    (f"refined_type IN ('categorical', 'text') AND {_NAMED('reason')} AND {_NAMED('decline|reject')}", "'decline_reason'", "dimension", 0.80),
    (f"refined_type IN ('categorical', 'text') AND {_NAMED(V.DESCRIPTION_NAME)}", "'description'", "text_field", 0.78),
    (f"refined_type = 'categorical' AND {_NAMED(V.STATUS_NAME)}", _name_case(V.STATUS_KINDS, "'status'"), "dimension", 0.82),
    (f"refined_type = 'categorical' AND {_NAMED(V.GEO_NAME)}", _name_case(V.GEO_KINDS, "'geographic'"), "dimension", 0.80),
    ("refined_type = 'categorical'", "'dimension'", "dimension", 0.70),
    (f"refined_type = 'text' AND {_NAMED('name|title|label')}", "'name'", "dimension", 0.75),
    ("refined_type = 'text'", "'text'", "text_field", 0.50),
]
_pick = lambda index, quote: "CASE " + " ".join(f"WHEN {c[0]} THEN {quote(c[index])}" for c in _CASES)
ROLE_ROWS = f"""{PROFILE}, grains AS (SELECT *, identifier_score >= 0.6 AND cardinality_ratio >= 0.98 AS grain FROM scored),
roles AS (SELECT *, {_pick(1, str)} END AS semantic_type, {_pick(2, lambda r: f"'{r}'")} ELSE 'unknown' END AS role,
 {_pick(3, lambda v: f"CAST({v} AS DOUBLE)")} ELSE 0.3 END AS role_confidence FROM grains)"""


@query("semantic_roles", f"""{ROLE_ROWS} SELECT "column", refined_type, semantic_type, role, role_confidence FROM roles""")
def semantic_roles(spark, folder):
    return described(spark, folder).select("column", "refined_type", "semantic_type", "role", "role_confidence")


def _points_sql(place: int, category: str) -> str:
    """Points of one category for the customer domain, and where a tie puts it."""
    w = V.CATEGORY_WEIGHTS
    parts, ties = [], []
    if category in V.CATEGORY_NAMES:
        named = _NAMED(V.CATEGORY_NAMES[category])
        parts.append(f"CASE WHEN {named} THEN {w['name_keyword_match']} ELSE 0 END")
        ties.append(f"WHEN {named} THEN {place}")
    parts.append(f"CASE WHEN by_type = '{category}' THEN {w['semantic_type_match']} ELSE 0 END")
    ties.append(f"WHEN by_type = '{category}' THEN 100")
    if category == "Time Series Data":
        parts += [f"CASE WHEN role = 'temporal_dimension' THEN {w['column_role_match']} ELSE 0 END", f"CASE WHEN tim >= 0.9 THEN {w['datetime_parse_match']} ELSE 0 END"]
    if category == "Master Data":
        parts.append(f"CASE WHEN role = 'identifier' THEN {w['column_role_match']} ELSE 0 END")
    if category in ("Time Series Data", "Master Data"):
        ties.append("WHEN role IN ('temporal_dimension', 'identifier') THEN 200")
    if category == "Customer Experience Data":
        parts.append(str(w["domain_context_boost_weak"]))
    return f"""SELECT "column", role, '{category}' AS category, round(CAST({' + '.join(parts)} AS DOUBLE), 4) AS points, CASE {' '.join(ties)} ELSE {300 + place} END AS place FROM kinds_"""


CATEGORY_ROWS = f"""{ROLE_ROWS}, kinds_ AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(semantic_type, '{'|'.join(words)}') THEN '{c}'" for c, words in V.CATEGORY_TYPES)} END AS by_type FROM roles),
pts AS ({' UNION ALL '.join(_points_sql(i, c) for i, c in enumerate(V.CATEGORIES))}),
ranked AS (SELECT *, row_number() OVER w AS rank, first_value(points) OVER w AS top FROM pts WINDOW w AS (PARTITION BY "column" ORDER BY points DESC, place)),
best AS (SELECT "column", max(category) FILTER (rank = 1) AS primary_category, max(top) AS top, max(points) FILTER (rank = 2 AND points > 0) AS second FROM ranked GROUP BY "column"),
extra AS (SELECT "column", string_agg(category, '|' ORDER BY rank) AS cats FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rank) AS k FROM ranked
 WHERE rank > 1 AND points >= 0.3 AND points >= top * 0.5) x WHERE k <= 3 GROUP BY "column")
SELECT b."column", primary_category, COALESCE(cats, '') AS secondary_categories,
 round(least(1.0, least(1.0, top) + CASE WHEN round(top - second, 4) > 0.3 THEN 0.1 ELSE 0 END), 3) AS confidence FROM best b LEFT JOIN extra e ON b."column" = e."column" """


@query("data_categories", CATEGORY_ROWS)
def data_categories(spark, folder):
    return refine.data_categories(described(spark, folder), "customer").withColumn("secondary_categories", F.array_join("secondary_categories", "|"))


def _domain_sql(place: int, label: str, spec: dict) -> str:
    words = "|".join(spec["keywords"])
    fits = " OR ".join(f"contains(semantic_type, '{r}') OR contains('{r}', semantic_type)" for r in spec["semantic_roles"]) or "false"
    return (f"SELECT {place} AS place, '{label}' AS domain, count(*) AS n, sum(CASE WHEN {_NAMED(words)} THEN 1.5 ELSE 0 END + CASE WHEN {fits} THEN 2.0 ELSE 0 END "
            f"+ CASE WHEN len(list_filter(reps[1:5], lambda v: regexp_matches(lower(v), '{words}'))) > 0 THEN 0.5 ELSE 0 END) AS points FROM roles")


@query("secondary_domain", f"""{ROLE_ROWS}, d AS ({' UNION ALL '.join(_domain_sql(i, k, v) for i, (k, v) in enumerate(V.DOMAINS['customer']['secondary_domains'].items()))}),
s AS (SELECT place, domain, CAST(least(1.0, points / greatest(n * 4.0 * 0.15, 1.0)) AS DOUBLE) AS score FROM d)
SELECT domain, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, place) AS rank, CASE WHEN score >= 0.75 THEN 'classified' WHEN score >= 0.5 THEN 'needs_review' ELSE 'unresolved' END AS status FROM s""")
def secondary_domain(spark, folder):
    return refine.secondary_domains(described(spark, folder), "customer")


@query("feature_split", f"""{ROLE_ROWS} SELECT "column", role, CASE WHEN grain THEN 'drop' WHEN role IN ('metric', 'dimension', 'temporal_dimension', 'flag') THEN 'keep' ELSE 'ignore' END AS decision,
 CASE WHEN NOT grain AND role IN ('metric', 'dimension', 'temporal_dimension', 'flag') THEN 'high' END AS usefulness FROM roles""")
def feature_split(spark, folder):
    return refine.feature_split(described(spark, folder))


@query("column_expectations", """SELECT x AS "column", NOT regexp_matches(lower(x), '(^|_)(id|identifier|uuid|guid)$') AS mandatory,
 regexp_matches(lower(x), '(^|_)(id|identifier|uuid|guid)$') AS expected_unique
 FROM (SELECT unnest([""" + _codes(list(CARD_KINDS)) + """]) AS x)""")
def column_expectations(spark, folder):
    return refine.expectations(profile.column_counts(card(spark, folder)))
