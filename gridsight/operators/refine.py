"""From profile rows to types, identifiers, roles, categories and domains.

Every operator takes the profile (one row per column) and adds columns or reshapes it;
the data itself is not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridsight.plans import vocabulary as V

CARDINALITY_THRESHOLD = 0.98
LONG_TEXT = 40


def _has(pattern: str) -> Column:
    return F.array_contains("dominant_patterns", pattern)


def _share_of_values(test) -> Column:
    """Share of the representative values that pass a test."""
    values = F.col("representative_values")
    return F.size(F.filter(values, test)) / F.greatest(F.size(values), F.lit(1))


def _coded(codes: list[str], label: str) -> Column:
    return _has(label) & (_share_of_values(lambda v: F.upper(v).isin(codes)) >= 0.7)


def refined_types(profile: DataFrame) -> DataFrame:
    """Adds ``refined_type``, the first of an ordered list of tests a column passes."""
    c = F.col
    numeric = c("numeric_parse_ratio") >= 0.90
    within = lambda low, high: (c("min_value") >= low) & (c("max_value") <= high)
    boolean = (((c("boolean_parse_ratio") >= 0.95) & (c("distinct_count") <= 3))
               | ((c("numeric_parse_ratio") >= 0.95) & (c("distinct_count") <= 2) & within(0, 1)))
    phone_by_name = (c("normalized_key").rlike(V.PHONE_NAME) & numeric
                     & (c("min_string_length") >= 7) & (c("max_string_length") <= 15))
    country = ((c("distinct_count") <= 250)
               & (_coded(V.COUNTRY_CODES_2, "TWO_LETTER_CODE") | _coded(V.COUNTRY_CODES_3, "THREE_LETTER_CODE")))
    percentage = numeric & within(0, 100) & c("normalized_key").rlike(V.PERCENT_NAME)
    identifier = _has("UUID") | (
        (c("avg_string_length") <= LONG_TEXT) & (c("cardinality_ratio") >= 0.98) & (c("non_null_count") > 10))
    categorical = (((c("cardinality_ratio") <= 0.05) & (c("distinct_count") <= 50))
                   | ((c("distinct_count") <= 20) & (c("non_null_count") >= 50)))
    tests = [
        (c("non_null_count") == 0, F.lit("unknown")),
        (boolean, F.lit("boolean")),
        (c("datetime_parse_ratio") >= 0.90,
         F.when(_has("YYYY-MM-DD") | _has("DATE_SLASH"), "date").otherwise("datetime")),
        (_has("EMAIL") | (_share_of_values(lambda v: v.rlike(V.EMAIL)) >= 0.8), F.lit("email")),
        (_has("PHONE") | (_share_of_values(lambda v: v.rlike(V.PHONE)) >= 0.8) | phone_by_name, F.lit("phone")),
        ((c("distinct_count") <= 50) & _coded(V.CURRENCY_CODES, "THREE_LETTER_CODE"), F.lit("currency_code")),
        (country, F.lit("country_code")),
        (percentage, F.lit("percentage")),
        (numeric, F.when(c("all_integer_valued"), "integer").otherwise("decimal")),
        (identifier, F.lit("identifier")),
        (categorical, F.lit("categorical")),
    ]
    return profile.withColumn("refined_type", _first(tests, F.lit("text")))


def _first(tests: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first test that holds; a null test does not hold."""
    chain = F.when(tests[0][0], tests[0][1])
    for test, value in tests[1:]:
        chain = chain.when(test, value)
    return chain.otherwise(otherwise)


def identifier_scores(typed: DataFrame) -> DataFrame:
    """Adds ``identifier_score`` and ``is_identifier`` (a column of the table's grain)."""
    c = F.col
    named = c("normalized_key").rlike(V.IDENTIFIER_NAME)
    points = [
        F.when(c("non_null_count") == 0, 0.0).when(c("cardinality_ratio") >= CARDINALITY_THRESHOLD, 0.50)
        .when(c("cardinality_ratio") >= 0.90, 0.25).otherwise(0.0),
        F.when(c("null_ratio") <= 0.01, 0.10).when(c("null_ratio") > 0.10, -0.15).otherwise(0.0),
        F.when((c("duplicate_count") == 0) & (c("non_null_count") > 1), 0.15).otherwise(0.0),
        F.when(_has("UUID"), 0.20).otherwise(0.0),
        F.when(c("refined_type") == "identifier", 0.10).otherwise(0.0),
        F.when(named, 0.05).otherwise(0.0),
        F.when((c("cardinality_ratio") < 0.50) & (c("non_null_count") > 10), -0.30).otherwise(0.0),
        F.when((c("refined_type") == "decimal") & ~named, -0.40).otherwise(0.0),
        F.when((c("avg_string_length") > LONG_TEXT) & ~named, -0.40).otherwise(0.0),
    ]
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, points)))
    # The sum of decimal points carries binary noise; the cut-off is on hundredths.
    score = F.round(score, 3)
    return (
        typed.withColumn("identifier_score", score)
        .withColumn("is_identifier", (F.col("identifier_score") >= 0.60)
                    & (F.col("cardinality_ratio") >= CARDINALITY_THRESHOLD))
    )


def _by_name(rules: list[tuple[str, str]], default: str) -> Column:
    name = F.col("normalized_key")
    return _first([(name.rlike(p), F.lit(t)) for p, t in rules], F.lit(default))


def semantic_roles(scored: DataFrame) -> DataFrame:
    """Adds ``semantic_type``, ``role`` and ``role_confidence``."""
    c = F.col
    name, kind = c("normalized_key"), c("refined_type")
    temporal, number = kind.isin("date", "datetime"), kind.isin("integer", "decimal")
    few = (c("cardinality_ratio") <= 0.05) & (c("distinct_count") <= 20)
    words = kind.isin("categorical", "text")
    date_default = F.when(kind == "date", "date").otherwise("datetime")

    def case(test: Column, semantic: Column | str, role: str, confidence: float):
        semantic = F.lit(semantic) if isinstance(semantic, str) else semantic
        return test, F.struct(semantic.alias("semantic_type"), F.lit(role).alias("role"),
                              F.lit(confidence).alias("role_confidence"))

    unknown = F.struct(F.lit(None).cast("string").alias("semantic_type"), F.lit("unknown").alias("role"),
                       F.lit(0.30).alias("role_confidence"))
    decided = _first([
        case(c("is_identifier"), _by_name(V.IDENTIFIER_KINDS, "identifier"), "identifier", 0.90),
        case(temporal, F.coalesce(F.nullif(_by_name(V.DATE_KINDS, "-"), F.lit("-")), date_default),
             "temporal_dimension", 0.88),
        case(kind == "boolean", _by_name(V.FLAG_KINDS, "flag"), "flag", 0.85),
        case(kind == "email", "email_address", "dimension", 0.92),
        case(kind == "phone", "phone_number", "dimension", 0.88),
        case(kind == "currency_code", "currency_code", "dimension", 0.93),
        case(kind == "country_code", "country_code", "dimension", 0.91),
        case(kind == "percentage", "percentage", "metric", 0.85),
        case(number & name.rlike(V.METRIC_NAME), _by_name(V.METRIC_KINDS, "monetary_amount"), "metric", 0.85),
        case(number & few, "numeric_category", "dimension", 0.70),
        case(number, "numeric_measure", "metric", 0.65),
        case(words & name.rlike("reason") & name.rlike("decline|reject"), "decline_reason", "dimension", 0.80),
        case(words & name.rlike(V.DESCRIPTION_NAME), "description", "text_field", 0.78),
        case((kind == "categorical") & name.rlike(V.STATUS_NAME), _by_name(V.STATUS_KINDS, "status"), "dimension", 0.82),
        case((kind == "categorical") & name.rlike(V.GEO_NAME), _by_name(V.GEO_KINDS, "geographic"), "dimension", 0.80),
        case(kind == "categorical", "dimension", "dimension", 0.70),
        case((kind == "text") & name.rlike("name|title|label"), "name", "dimension", 0.75),
        case(kind == "text", "text", "text_field", 0.50),
    ], unknown)
    return scored.withColumn("_role", decided).select(*scored.columns, "_role.*")


def described_columns(profile: DataFrame) -> DataFrame:
    """Profile rows with type, identifier score and role."""
    return semantic_roles(identifier_scores(refined_types(profile)))


def data_categories(described: DataFrame, primary_domain: str) -> DataFrame:
    """Primary and up to three secondary data categories per column, with confidence."""
    c = F.col
    weight, select = V.CATEGORY_WEIGHTS, V.CATEGORY_SELECTION
    name, role = c("normalized_key"), c("role")
    semantic = F.lower(F.coalesce(c("semantic_type"), F.lit("")))
    by_type = _first([(semantic.rlike("|".join(words)), F.lit(category)) for category, words in V.CATEGORY_TYPES],
                     F.lit(None).cast("string"))
    boost = V.CATEGORY_DOMAINS.get(primary_domain.lower())

    def points(category: str) -> Column:
        parts = []
        if category in V.CATEGORY_NAMES:
            parts.append(F.when(name.rlike(V.CATEGORY_NAMES[category]), weight["name_keyword_match"]))
        parts.append(F.when(by_type == category, weight["semantic_type_match"]))
        if category == "Time Series Data":
            parts.append(F.when(role == "temporal_dimension", weight["column_role_match"]))
            parts.append(F.when(c("datetime_parse_ratio") >= 0.9, weight["datetime_parse_match"]))
        if category == "Master Data":
            parts.append(F.when(role == "identifier", weight["column_role_match"]))
        if boost and boost[0] == category:
            parts.append(F.lit(weight[boost[1]]))
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])

    def place(i: int, category: str) -> Column:
        """Tie order: name signals in list order, then type, role, domain and date signals."""
        signals = [(name.rlike(V.CATEGORY_NAMES[category]), F.lit(i))] if category in V.CATEGORY_NAMES else []
        signals.append((by_type == category, F.lit(100)))
        if category in ("Time Series Data", "Master Data"):
            signals.append((role.isin("temporal_dimension", "identifier"), F.lit(200)))
        return _first(signals, F.lit(300 + i))

    long = described.select(
        "column", "role",
        F.explode(F.array(*[F.struct(place(i, k).alias("place"), F.lit(k).alias("category"),
                                     F.round(points(k), 4).alias("points"))
                            for i, k in enumerate(V.CATEGORIES)])).alias("k")
    ).select("column", "role", "k.*")
    # Eleven categories per column reach the window.
    order = W.partitionBy("column").orderBy(F.desc("points"), F.asc("place"))
    ranked = long.withColumn("rank", F.row_number().over(order))
    top = F.max(F.when(c("rank") == 1, c("points")))
    picked = ranked.groupBy("column", "role").agg(
        F.max(F.when(c("rank") == 1, c("category"))).alias("best"), top.alias("top"),
        F.max(F.when((c("rank") == 2) & (c("points") > 0), c("points"))).alias("second"),
        F.array_sort(F.collect_list(F.when((c("rank") > 1) & (c("points") >= select["secondary_min_absolute"]),
                                           F.struct("rank", "points", "category")))).alias("others"))
    default = F.when(role == "temporal_dimension", "Time Series Data").when(role == "identifier", "Master Data").otherwise("Operational Data")
    confidence = F.least(F.lit(1.0), c("top"))
    gap = F.round(c("top") - c("second"), 4) > select["confidence_gap_threshold"]
    kept = F.filter("others", lambda o: o["points"] >= c("top") * select["secondary_min_ratio_of_primary"])
    return picked.select(
        "column",
        F.when(c("top") > 0, c("best")).otherwise(default).alias("primary_category"),
        F.slice(F.transform(kept, lambda o: o["category"]), 1, select["max_secondary_categories"]).alias("secondary_categories"),
        F.when(c("top") == 0, 0.50).otherwise(F.round(F.when(gap, F.least(F.lit(1.0), confidence + select["confidence_gap_boost"]))
                                              .otherwise(confidence), 3)).alias("confidence"))


def secondary_domains(described: DataFrame, domain: str) -> DataFrame:
    """Score and status of each secondary domain of a primary domain, best first."""
    c = F.col
    scores = []
    for place, (label, spec) in enumerate(V.DOMAINS[domain.lower()]["secondary_domains"].items()):
        keywords = "|".join(k.lower() for k in spec["keywords"])
        by_name = F.when(F.lower("normalized_key").rlike(keywords), 1.5).otherwise(0.0)
        semantic = F.lower("semantic_type")
        fits = [semantic.contains(r.lower()) | F.lit(r.lower()).contains(semantic) for r in spec["semantic_roles"]]
        by_role = F.when(F.coalesce(reduce(lambda a, b: a | b, fits, F.lit(False)), F.lit(False)), 2.0).otherwise(0.0)
        by_value = F.when(F.exists(F.slice("representative_values", 1, 5), lambda v: F.lower(v).rlike(keywords)), 0.5).otherwise(0.0)
        scores.append(F.struct(F.lit(place).alias("place"), F.lit(label).alias("domain"), F.sum(by_name + by_role + by_value).alias("points")))
    total = described.agg(F.count(F.lit(1)).alias("n"), F.array(*scores).alias("s"))
    score = F.least(F.lit(1.0), c("s.points") / F.greatest(c("n") * 4.0 * 0.15, F.lit(1.0)))
    # A handful of configured domains: one task may rank them.
    order = W.partitionBy("n").orderBy(F.desc("score"), F.asc("place"))
    return (
        total.select("n", F.explode("s").alias("s")).select("n", "s.place", "s.domain", score.alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .select("domain", F.round("score", 4).alias("score"), "rank",
                F.when(c("score") >= 0.75, "classified").when(c("score") >= 0.50, "needs_review")
                .otherwise("unresolved").alias("status"))
    )


def expectations(described: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """Which columns must be filled and which must be unique, judged by name or by a description that says so."""
    said = [c for c, text in (descriptions or {}).items() if "unique identifier" in (text or "").lower()]
    unique = F.col("column").rlike(V.EXPECTED_UNIQUE_NAME) | F.col("column").isin(said)
    return described.select("column", (~unique).alias("mandatory"), unique.alias("expected_unique"))


def feature_split(described: DataFrame) -> DataFrame:
    """``keep`` for columns a model can use, ``drop`` for grain columns, else ``ignore``."""
    usable = F.col("role").isin("metric", "dimension", "temporal_dimension", "flag")
    return described.select(
        "column", "role",
        F.when(F.col("is_identifier"), "drop").when(usable, "keep").otherwise("ignore").alias("decision"),
        F.when(usable & ~F.col("is_identifier"), "high").alias("usefulness"))
