"""Outliers and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsight.operators import anomaly, segment
from gridsight.plans.inputs import INSURANCE
from gridsight.queries.registry import prepared, query, table

# Order lines with gaps and a few stretched values.
LINES = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS quantity,
 CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 4 ELSE l_extendedprice END AS price, CASE WHEN l_orderkey % 501 = 0 THEN l_discount + 1 ELSE l_discount END AS discount FROM {lineitem}"""
FEATURES, KEEP = ["quantity", "price", "discount"], ["l_orderkey", "l_linenumber"]
FILLED = f"""WITH l AS ({LINES}), m AS (SELECT quantile_cont(quantity, 0.5) AS mq FROM l),
f AS (SELECT l_orderkey, l_linenumber, COALESCE(quantity, mq) AS quantity, price, discount FROM l, m)"""
SHOW = "SELECT l_orderkey, l_linenumber, round(quantity, 4) AS quantity, round(price, 4) AS price, round(discount, 4) AS discount, round({score}, 4) AS anomaly_score FROM z WHERE {test}"
ZSCORES = f"""{FILLED}, s AS (SELECT avg(quantity) AS m1, stddev_pop(quantity) AS s1, avg(price) AS m2, stddev_pop(price) AS s2, avg(discount) AS m3, stddev_pop(discount) AS s3 FROM f),
z AS (SELECT f.*, greatest(abs((quantity - m1) / s1), abs((price - m2) / s2), abs((discount - m3) / s3)) AS z FROM f, s)"""


def _lines(spark, folder):
    return prepared(spark, folder, LINES)


@query("anomaly_zscore", f"{ZSCORES} {SHOW.format(score='-z', test='z > 3')}")
def anomaly_zscore(spark, folder):
    return anomaly.zscore(_lines(spark, folder), FEATURES, KEEP)


@query("outliers", f"{ZSCORES} SELECT count(*) AS total_records, count(*) FILTER (z > 3) AS anomaly_count, round(count(*) FILTER (z > 3) / count(*) * 100, 2) AS anomaly_rate_pct FROM z")
def outliers(spark, folder):
    lines = _lines(spark, folder)
    return anomaly.anomaly_summary(lines, anomaly.outliers(lines, FEATURES, KEEP), FEATURES)


@query("anomaly_iqr", f"""{FILLED}, q AS (SELECT quantile_cont(quantity, 0.25) AS a1, quantile_cont(quantity, 0.75) AS b1, quantile_cont(price, 0.25) AS a2, quantile_cont(price, 0.75) AS b2,
 quantile_cont(discount, 0.25) AS a3, quantile_cont(discount, 0.75) AS b3 FROM f),
z AS (SELECT f.*, greatest(""" + ", ".join(f"(a{i} - 1.5 * (b{i} - a{i}) - {c}) / (b{i} - a{i}), ({c} - (b{i} + 1.5 * (b{i} - a{i}))) / (b{i} - a{i})" for i, c in enumerate(FEATURES, 1)) + f""") AS d FROM f, q)
{SHOW.format(score='d', test='d > 0')}""")
def anomaly_iqr(spark, folder):
    return anomaly.iqr(_lines(spark, folder), FEATURES, KEEP)


@query("anomaly_mad", f"""{FILLED}, q AS (SELECT quantile_cont(quantity, 0.5) AS m1, quantile_cont(price, 0.5) AS m2, quantile_cont(discount, 0.5) AS m3 FROM f),
a AS (SELECT quantile_cont(abs(quantity - m1), 0.5) AS d1, quantile_cont(abs(price - m2), 0.5) AS d2, quantile_cont(abs(discount - m3), 0.5) AS d3 FROM f, q),
z AS (SELECT f.*, greatest(abs(0.6745 * (quantity - m1) / d1), abs(0.6745 * (price - m2) / d2), abs(0.6745 * (discount - m3) / d3)) AS z FROM f, q, a)
{SHOW.format(score='-z', test='z > 3.5')}""")
def anomaly_mad(spark, folder):
    return anomaly.modified_zscore(_lines(spark, folder), FEATURES, KEEP)


@query("anomaly_iforest")
def anomaly_iforest(spark, folder):
    lines = _lines(spark, folder).withColumn("line_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    nodes, scaling = anomaly.fit_forest(lines, FEATURES, "line_key")
    return anomaly.forest_anomalies(anomaly.score_forest(lines, nodes, scaling, KEEP))


@query("anomaly_ocsvm")
def anomaly_ocsvm(spark, folder):
    return anomaly.one_class_boundary(_lines(spark, folder), FEATURES, KEEP)


# --- Segments ----------------------------------------------------------------------

def _bin_sql(edges: list[str], labels: list[str], column: str, source: str, head: str) -> str:
    parts = []
    for i, label in enumerate(labels):
        low = f"{column} > {edges[i]}" if i else "true"
        parts.append(f"SELECT {i} AS bin, '{label}' AS segment, round({edges[i]}, 4) AS range_start, round({edges[i + 1]}, 4) AS range_end, "
                     f"count(*) FILTER (({low}) AND {column} <= {edges[i + 1]}) AS count FROM {source}, e GROUP BY {edges[i]}, {edges[i + 1]}")
    return head + "\n" + "\nUNION ALL ".join(parts)


def _edges(df):
    return df.withColumns({c: F.round(c, 4) for c in ("range_start", "range_end")})


@query("seg_quartiles", _bin_sql([f"e{i}" for i in range(5)], segment.QUARTILES, "o_totalprice", "orders",
                                 "WITH e AS (SELECT " + ", ".join(f"quantile_cont(o_totalprice, {i / 4}) AS e{i}" for i in range(5)) + " FROM orders)"))
def seg_quartiles(spark, folder):
    return _edges(segment.quartiles(table(spark, folder, "orders"), "o_totalprice"))


@query("seg_equal_width", _bin_sql(["e0", "e1", "e2", "e3"], ["Bin 1", "Bin 2", "Bin 3"], "o_totalprice", "orders",
       "WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), e AS (SELECT lo - (hi - lo) * 0.001 AS e0, lo + (hi - lo) / 3 AS e1, lo + (hi - lo) * 2 / 3 AS e2, hi AS e3 FROM r)"))
def seg_equal_width(spark, folder):
    return _edges(segment.equal_width(table(spark, folder, "orders"), "o_totalprice"))


@query("seg_equal_frequency", _bin_sql(["e0", "e1", "e2", "e3"], ["Bin 1", "Bin 2", "Bin 3"], "c_acctbal", "customer",
       "WITH e AS (SELECT " + ", ".join(f"quantile_cont(c_acctbal, {i} / 3.0) AS e{i}" for i in range(4)) + " FROM customer)"))
def seg_equal_frequency(spark, folder):
    return _edges(segment.equal_frequency(table(spark, folder, "customer"), "c_acctbal"))


@query("seg_categorical", "SELECT p_type AS segment, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type")
def seg_categorical(spark, folder):
    return segment.categories(table(spark, folder, "part"), "p_type")


RATIO_ROWS = f"SELECT country, business_unit, sum(gross_claims_incurred) / sum(earned_premium) * 100 AS combined_ratio_actual FROM ({INSURANCE}) i GROUP BY country, business_unit"


@query("seg_ratio_buckets", f"""WITH r AS ({RATIO_ROWS}) SELECT 'Low Risk (<90% Combined Ratio)' AS segment, count(*) FILTER (combined_ratio_actual < 90) AS count FROM r
 UNION ALL SELECT 'Medium Risk (90-100% Combined Ratio)', count(*) FILTER (combined_ratio_actual BETWEEN 90 AND 100) FROM r
 UNION ALL SELECT 'High Risk (>100% Combined Ratio)', count(*) FILTER (combined_ratio_actual > 100) FROM r""")
def seg_ratio_buckets(spark, folder):
    return segment.ratio_buckets(prepared(spark, folder, RATIO_ROWS), "combined_ratio_actual")
