"""Association, distribution and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsight.operators import stats, timeseries as ts
from gridsight.plans.inputs import SALES, STAR
from gridsight.queries.registry import prepared, query, table
from gridsight.queries.structure import histogram_sql

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]
PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:]]
CORR_INPUT = """SELECT l_orderkey, l_quantity, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_discount, l_tax, o_totalprice
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""


@query("corr_pearson", f"WITH i AS ({CORR_INPUT}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, round(corr({a}, {b}), 4) AS correlation FROM i WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS))
def corr_pearson(spark, folder):
    return stats.pearson(prepared(spark, folder, CORR_INPUT), COLUMNS, with_p=False)


@query("corr_p_values")
def corr_p_values(spark, folder):
    return stats.pearson(prepared(spark, folder, CORR_INPUT), COLUMNS)


def _ranks(a: str, b: str) -> str:
    average = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, round(corr(ra, rb), 4) AS correlation FROM "
            f"(SELECT {average(a)} AS ra, {average(b)} AS rb FROM i WHERE {a} IS NOT NULL AND {b} IS NOT NULL) r")


@query("corr_spearman", f"WITH i AS ({CORR_INPUT}) " + " UNION ALL ".join(_ranks(a, b) for a, b in PAIRS))
def corr_spearman(spark, folder):
    return stats.spearman(prepared(spark, folder, CORR_INPUT), COLUMNS, with_p=False)


@query("distribution", """SELECT count(value) AS count, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(min(value), 2) AS min, round(max(value), 2) AS max,
 round(quantile_cont(value, 0.05), 2) AS p5, round(quantile_cont(value, 0.25), 2) AS p25, round(quantile_cont(value, 0.5), 2) AS p50,
 round(quantile_cont(value, 0.75), 2) AS p75, round(quantile_cont(value, 0.95), 2) AS p95 FROM events""")
def distribution(spark, folder):
    return stats.distribution(table(spark, folder, "events"), "value")


@query("distribution_bins", histogram_sql("p_size", "part", "least(10, count(DISTINCT p_size))"))
def distribution_bins(spark, folder):
    return stats.distribution_bins(table(spark, folder, "part"), "p_size")


@query("distribution_by", """SELECT event_type AS label, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, count(*) AS count FROM events
 WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type""")
def distribution_by(spark, folder):
    return stats.distribution_by(table(spark, folder, "events"), "value", "event_type")


DIMENSIONS = ["r_name", "c_mktsegment", "l_returnflag"]


@query("contingency", f"WITH s AS ({STAR}) " + " UNION ALL ".join(
    f"""SELECT '{a}' AS column_a, '{b}' AS column_b, {a} AS value_a, {b} AS value_b, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY {a}), 4) AS probability
 FROM s GROUP BY {a}, {b}""" for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[i + 1:]))
def contingency(spark, folder):
    return stats.contingency(prepared(spark, folder, STAR), DIMENSIONS)


SUPPORT = 0.012


@query("frequent_itemsets", f"""WITH p AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT b) AS n FROM p),
s AS (SELECT i AS items, 1 AS size, count(*) AS freq FROM p GROUP BY i UNION ALL
 SELECT x.i || '|' || y.i, 2, count(*) FROM p x JOIN p y ON x.b = y.b AND x.i < y.i GROUP BY x.i, y.i UNION ALL
 SELECT x.i || '|' || y.i || '|' || z.i, 3, count(*) FROM p x JOIN p y ON x.b = y.b AND x.i < y.i JOIN p z ON y.b = z.b AND y.i < z.i GROUP BY x.i, y.i, z.i)
SELECT items, size, freq, n AS baskets FROM s, n WHERE freq >= {SUPPORT} * n""")
def frequent_itemsets(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.frequent_itemsets(lines, "l_orderkey", "p_brand", SUPPORT).withColumn("items", F.array_join("items", "|"))


@query("association_rules", f"""WITH p AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT b) AS n FROM p),
a AS (SELECT i, count(*) AS f FROM p GROUP BY i), s AS (SELECT x.i AS antecedent, y.i AS consequent, count(*) AS f FROM p x JOIN p y ON x.b = y.b AND x.i <> y.i GROUP BY x.i, y.i)
SELECT antecedent, consequent, round(s.f / l.f, 4) AS confidence, round((s.f / l.f) / (r.f / n), 4) AS lift, round(s.f / n, 6) AS support
FROM s JOIN a l ON l.i = antecedent JOIN a r ON r.i = consequent, n WHERE s.f >= {SUPPORT} * n""")
def association_rules(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = stats.frequent_itemsets(lines, "l_orderkey", "p_brand", SUPPORT).where("size <= 2")
    return stats.association_rules(sets).withColumn("antecedent", F.array_join("antecedent", "|"))


# --- Series: order value per month and market segment ------------------------------

KEYS = ["c_mktsegment"]
SERIES = f"""WITH sales AS ({SALES}), series AS (SELECT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, sum(o_totalprice) AS y FROM sales GROUP BY c_mktsegment, ds),
gaps AS (SELECT *, date_diff('day', lag(ds) OVER w, ds) AS gap, row_number() OVER w - 1 AS x, lag(y) OVER w AS before, lag(y, 4) OVER w AS before4,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY ds DESC) AS back FROM series WINDOW w AS (PARTITION BY c_mktsegment ORDER BY ds)),
shape AS (SELECT c_mktsegment, count(*) AS n, max(ds) AS last_ds, arg_min(y, ds) AS first_y, arg_max(y, ds) AS last_y, quantile_cont(gap, 0.5) AS step FROM gaps GROUP BY c_mktsegment),
h AS (SELECT unnest(range(1, 7)) AS h)"""
TURN = "CASE WHEN ({l} - {f}) / abs({f}) * 100 > 1 THEN 'increasing' WHEN ({l} - {f}) / abs({f}) * 100 < -1 THEN 'decreasing' ELSE 'flat' END"
AHEAD = "last_ds + CAST(floor(step * h) AS INTEGER) AS ds"


def _series(spark, folder):
    return ts.build_series(prepared(spark, folder, SALES), "o_orderdate", "o_totalprice", KEYS, "month")


@query("ts_build", f"{SERIES} SELECT c_mktsegment, ds, round(y, 2) AS y FROM series")
def ts_build(spark, folder):
    return _series(spark, folder).withColumn("y", F.round("y", 2))


@query("ts_frequency", f"""{SERIES} SELECT c_mktsegment, n AS data_points, CAST(step AS DOUBLE) AS median_gap_days,
 CASE WHEN step <= 1.5 THEN 'D' WHEN step <= 8 THEN 'W' WHEN step <= 45 THEN 'ME' WHEN step <= 135 THEN 'QE' ELSE 'YE' END AS frequency FROM shape""")
def ts_frequency(spark, folder):
    return ts.frequency(_series(spark, folder), KEYS)


@query("ts_describe", f"""{SERIES} SELECT c_mktsegment, count(*) AS data_points, min(ds) AS start_date, max(ds) AS end_date, round(avg(y), 2) AS mean, round(stddev_pop(y), 2) AS std,
 round(min(y), 2) AS min, round(max(y), 2) AS max, round(stddev_pop(y) / abs(avg(y)), 4) AS volatility_ratio, count(*) >= 8 AND corr(y, before4) > 0.5 AS seasonality_flag FROM gaps GROUP BY c_mktsegment""")
def ts_describe(spark, folder):
    return ts.describe_series(_series(spark, folder), KEYS)


def _forecast_sql(per_key: str, yhat: str, spread: str, trend: str, extra: str = "") -> str:
    return f"""{SERIES}, k AS ({per_key}) SELECT c_mktsegment, h, {AHEAD}, round({yhat}, 2) AS yhat, round({yhat} - {spread}, 2) AS yhat_lower, round({yhat} + {spread}, 2) AS yhat_upper,
 {trend} AS trend_direction{extra} FROM k JOIN shape USING (c_mktsegment), h"""


@query("fc_moving_average", _forecast_sql("SELECT c_mktsegment, avg(y) AS mean, stddev_pop(y) AS sd FROM gaps WHERE back <= 3 GROUP BY c_mktsegment", "mean", "sd", "'flat'"))
def fc_moving_average(spark, folder):
    return ts.moving_average(_series(spark, folder), KEYS)


@query("fc_linear_trend", _forecast_sql(
    """SELECT c_mktsegment, slope, intercept, sqrt(avg((y - slope * x - intercept) * (y - slope * x - intercept))) AS sd FROM gaps
 JOIN (SELECT c_mktsegment, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM gaps GROUP BY c_mktsegment) f USING (c_mktsegment) GROUP BY c_mktsegment, slope, intercept""",
    "(slope * (n - 1 + h) + intercept)", "sd", TURN.format(l="last_y", f="first_y"), ", round(slope, 4) AS trend_slope"))
def fc_linear_trend(spark, folder):
    return ts.linear_trend(_series(spark, folder), KEYS)


@query("fc_exp_smoothing", SERIES.replace("WITH sales", "WITH RECURSIVE sales", 1) + f""", sm AS (SELECT c_mktsegment, x, y, y AS level FROM gaps WHERE x = 0
 UNION ALL SELECT g.c_mktsegment, g.x, g.y, 0.3 * g.y + (1 - 0.3) * sm.level FROM sm JOIN gaps g ON g.c_mktsegment = sm.c_mktsegment AND g.x = sm.x + 1),
k AS (SELECT c_mktsegment, arg_max(level, x) AS level, stddev_pop(y - level) AS sd FROM sm GROUP BY c_mktsegment)
SELECT c_mktsegment, h, {AHEAD}, round(level, 2) AS yhat, round(level - sd, 2) AS yhat_lower, round(level + sd, 2) AS yhat_upper, {TURN.format(l='level', f='first_y')} AS trend_direction
FROM k JOIN shape USING (c_mktsegment), h""")
def fc_exp_smoothing(spark, folder):
    return ts.exponential_smoothing(_series(spark, folder), KEYS)


@query("smoothed_series", SERIES.replace("WITH sales", "WITH RECURSIVE sales", 1) + """, sm AS (SELECT c_mktsegment, x, ds, y, y AS level FROM gaps WHERE x = 0
 UNION ALL SELECT g.c_mktsegment, g.x, g.ds, g.y, 0.3 * g.y + (1 - 0.3) * sm.level FROM sm JOIN gaps g ON g.c_mktsegment = sm.c_mktsegment AND g.x = sm.x + 1)
SELECT c_mktsegment, ds, round(y, 2) AS y, round(level, 2) AS smoothed FROM sm""")
def smoothed_series(spark, folder):
    return ts.smoothed_series(_series(spark, folder), KEYS)


@query("fc_autoregressive", _forecast_sql(
    """SELECT c_mktsegment, phi, c, sqrt(avg((y - phi * before - c) * (y - phi * before - c))) AS sd FROM gaps
 JOIN (SELECT c_mktsegment, regr_slope(y, before) AS phi, regr_intercept(y, before) AS c FROM gaps GROUP BY c_mktsegment) f USING (c_mktsegment) WHERE before IS NOT NULL GROUP BY c_mktsegment, phi, c""",
    "(pow(phi, h) * last_y + c * (1 - pow(phi, h)) / (1 - phi))", "sd", TURN.format(l="last_y", f="first_y"), ", round(phi, 4) AS phi"))
def fc_autoregressive(spark, folder):
    return ts.autoregressive(_series(spark, folder), KEYS)


@query("fc_fourier")
def fc_fourier(spark, folder):
    return ts.seasonal_forecast(_series(spark, folder), KEYS)
