"""KPI arithmetic and root cause."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsight.operators import kpi, rootcause
from gridsight.plans import kpis as K
from gridsight.plans.inputs import FINANCE, SALES
from gridsight.queries.registry import prepared, query, table


def _finance(spark, folder):
    return prepared(spark, folder, FINANCE)


METHOD_SQL = {"sum": "sum({})", "mean": "avg({})", "median": "quantile_cont({}, 0.5)", "min": "min({})", "max": "max({})", "count": "count({})"}


@query("kpi_aggregate", "\nUNION ALL ".join(f"SELECT '{m}' AS method, CAST(round(COALESCE({s.format('o_totalprice')}, 0), 4) AS DOUBLE) AS value FROM orders" for m, s in METHOD_SQL.items()))
def kpi_aggregate(spark, folder):
    orders = table(spark, folder, "orders")
    parts = [kpi.aggregate(orders, "o_totalprice", m).select(F.lit(m).alias("method"), F.round("value", 4).alias("value")) for m in kpi.METHODS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _variance_sql(a: str, b: str, better: bool = True) -> str:
    good, bad = ("favorable", "unfavorable") if better else ("unfavorable", "favorable")
    return (f"round({a} - {b}, 2) AS variance_amount, round(CASE WHEN {b} <> 0 THEN ({a} - {b}) / abs({b}) * 100 END, 2) AS variance_pct, "
            f"CASE WHEN {a} > {b} THEN '{good}' WHEN {a} < {b} THEN '{bad}' ELSE 'neutral' END AS direction")


@query("kpi_variance", f"""WITH g AS (SELECT country, business_unit, sum(revenue_actual) AS a, sum(revenue_budget) AS b FROM ({FINANCE}) f GROUP BY country, business_unit)
SELECT country, business_unit, round(a, 2) AS actual, round(b, 2) AS reference, {_variance_sql('a', 'b')} FROM g""")
def kpi_variance(spark, folder):
    return kpi.variance(_finance(spark, folder), "revenue_actual", "revenue_budget", ["country", "business_unit"])


@query("kpi_growth", """WITH g AS (SELECT r_name, year(o_orderdate) AS period, sum(o_totalprice) AS v FROM (""" + SALES + """) s GROUP BY r_name, period),
l AS (SELECT *, lag(v) OVER (PARTITION BY r_name ORDER BY period) AS p FROM g)
SELECT r_name, period, round(v, 2) AS current, round(p, 2) AS previous, round(CASE WHEN p <> 0 THEN (v - p) / abs(p) * 100 END, 2) AS growth_pct FROM l""")
def kpi_growth(spark, folder):
    return kpi.growth(prepared(spark, folder, SALES), F.year("o_orderdate"), "o_totalprice", keys=["r_name"])


@query("trend", """WITH d AS (SELECT c_mktsegment, o_orderdate AS d, sum(o_totalprice) AS v FROM (""" + SALES + """) s GROUP BY c_mktsegment, o_orderdate),
e AS (SELECT c_mktsegment, arg_min(v, d) AS f, arg_max(v, d) AS l, count(*) AS n FROM d GROUP BY c_mktsegment)
SELECT c_mktsegment, round(f, 2) AS first_value, round(l, 2) AS last_value, round((l - f) / abs(f) * 100, 2) AS overall_change_pct,
 CASE WHEN (l - f) / abs(f) * 100 > 1 THEN 'increasing' WHEN (l - f) / abs(f) * 100 < -1 THEN 'decreasing' ELSE 'flat' END AS direction, n AS data_points FROM e WHERE n >= 2""")
def trend(spark, folder):
    return kpi.trend(prepared(spark, folder, SALES), "o_orderdate", "o_totalprice", ["c_mktsegment"])


@query("rank_topn", """SELECT o_orderkey AS label, o_totalprice AS value, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def rank_topn(spark, folder):
    return kpi.rank_rows(table(spark, folder, "orders"), "o_totalprice", "o_orderkey", top=10)


@query("contribution", """WITH g AS (SELECT p_brand AS label, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT label, round(v, 2) AS value, round(abs(v) / (SELECT sum(abs(v)) FROM g) * 100, 2) AS contribution_pct FROM g""")
def contribution(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return kpi.contribution(lines, "l_extendedprice", "p_brand")


@query("compare_groups", """WITH g AS (SELECT c_mktsegment AS label, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rank, count(*) OVER () AS group_count FROM g)
SELECT label, round(v, 2) AS value, rank, group_count, CASE WHEN rank = 1 THEN 'highest' WHEN rank = group_count THEN 'lowest' END AS extreme FROM r""")
def compare_groups(spark, folder):
    sales = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return kpi.compare_groups(sales, "o_totalprice", "c_mktsegment")


@query("compare_customers", """WITH g AS (SELECT o_custkey AS label, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (ORDER BY round(v, 6) DESC, label) AS rank, count(*) OVER () AS group_count FROM g)
SELECT label, round(v, 2) AS value, rank, group_count, CASE WHEN rank = 1 THEN 'highest' WHEN rank = group_count THEN 'lowest' END AS extreme FROM r""")
def compare_customers(spark, folder):
    # Many groups: ranked by range-sorted parts, the form large results take.
    return kpi.compare_groups(table(spark, folder, "orders"), "o_totalprice", "o_custkey")


def _summary_sql(keys: list[str], prior: bool) -> str:
    parts = []
    for k in K.CATALOGS["finance"]:
        if k["key"] == "net_profit":
            continue
        a, b = k["actual_column"], k["budget_column"]
        extra = ""
        if prior:
            p = k.get("prior_year_column")
            inner = f"sum({p})" if p else "CAST(NULL AS DOUBLE)"
            extra = (f", round({inner}, 2) AS prior_year, round(sum({a}) - {inner}, 2) AS variance_vs_prior_year_amount, "
                     f"round(CASE WHEN {inner} <> 0 THEN (sum({a}) - {inner}) / abs({inner}) * 100 END, 2) AS variance_vs_prior_year_pct")
        parts.append(f"SELECT {''.join(c + ', ' for c in keys)}'{k['key']}' AS kpi, '{k['unit']}' AS unit, round(sum({a}), 2) AS actual, round(sum({b}), 2) AS budget, "
                     f"{_variance_sql(f'sum({a})', f'sum({b})', k['higher_is_better'])}{extra} FROM f {'GROUP BY ' + ', '.join(keys) if keys else ''}")
    return f"WITH f AS ({FINANCE}) " + " UNION ALL ".join(parts)


@query("kpi_summary", _summary_sql([], False))
def kpi_summary(spark, folder):
    return kpi.kpi_summary(_finance(spark, folder), K.CATALOGS["finance"])


@query("kpi_variance_prior", _summary_sql(["region"], True))
def kpi_variance_prior(spark, folder):
    return kpi.kpi_summary(_finance(spark, folder), K.CATALOGS["finance"], keys=["region"], prior_year=True)


ROLES = [
    {"column": "revenue_actual", "semantic_type": "revenue_amount", "role": "metric"},
    {"column": "cost_actual", "semantic_type": "expense_amount", "role": "metric"},
    {"column": "revenue_budget", "semantic_type": "forecast_amount", "role": "metric"},
    {"column": "cost_budget", "semantic_type": "actual_amount", "role": "metric"},
    {"column": "o_totalprice", "semantic_type": "monetary_amount", "role": "metric"},
    {"column": "base_pay", "semantic_type": "salary_amount", "role": "metric"},
    {"column": "claim_cost", "semantic_type": "claims_amount", "role": "metric"},
    {"column": "line_quantity", "semantic_type": "count_metric", "role": "metric"},
    {"column": "line_share", "semantic_type": "numeric_measure", "role": "metric"},
    {"column": "settlement_status", "semantic_type": "status", "role": "dimension"},
    {"column": "o_orderdate", "semantic_type": "date", "role": "temporal_dimension"},
]
KPI_INPUT = """SELECT l_extendedprice AS revenue_actual, 20 * l_quantity AS cost_actual, l_extendedprice - 3 * l_quantity AS revenue_budget, 21 * l_quantity AS cost_budget,
 o_totalprice, o_totalprice / 4 AS base_pay, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS claim_cost, l_quantity AS line_quantity, l_tax * 100 + 1 AS line_share,
 CASE WHEN l_linestatus = 'F' THEN 'Settled' ELSE 'open' END AS settlement_status, o_orderdate FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""


@query("discovered_kpis", f"""WITH i AS ({KPI_INPUT}), d AS (SELECT o_orderdate AS d, sum(revenue_actual) AS v FROM i GROUP BY o_orderdate),
k AS (SELECT 'Profit Margin' AS kpi, 'financial_measure' AS category, 'revenue_actual, cost_actual' AS columns, 'ratio' AS measure, (sum(revenue_actual) - sum(cost_actual)) / sum(revenue_actual) AS value FROM i
UNION ALL SELECT 'Success Rate', 'payment_measure', 'o_totalprice, settlement_status', 'rate', count(*) FILTER (lower(settlement_status) = 'settled') / count(*) FROM i
UNION ALL SELECT 'Salary Distribution', 'compensation_measure', 'base_pay', 'p25', quantile_cont(base_pay, 0.25) FROM i
UNION ALL SELECT 'Salary Distribution', 'compensation_measure', 'base_pay', 'p50', quantile_cont(base_pay, 0.5) FROM i
UNION ALL SELECT 'Salary Distribution', 'compensation_measure', 'base_pay', 'p75', quantile_cont(base_pay, 0.75) FROM i
UNION ALL SELECT 'Claim Frequency', 'insurance_measure', 'claim_cost', 'rate', count(claim_cost) / count(*) FROM i
UNION ALL SELECT 'Variance vs Budget', 'financial_measure', 'cost_budget, revenue_budget', 'ratio', (sum(cost_budget) - sum(revenue_budget)) / sum(revenue_budget) FROM i
UNION ALL SELECT 'Ratio Analysis', 'financial_measure', 'line_quantity, line_share', 'ratio', sum(line_quantity) / sum(line_share) FROM i
UNION ALL SELECT 'Volume Trend', 'financial_measure', 'revenue_actual, o_orderdate', 'change_pct', round((arg_max(v, d) - arg_min(v, d)) / abs(arg_min(v, d)) * 100, 2) FROM d)
SELECT kpi, category, columns, measure, round(value, 6) AS value FROM k""")
def discovered_kpis(spark, folder):
    return rootcause.discovered_kpis(prepared(spark, folder, KPI_INPUT), ROLES).withColumn("value", F.round("value", 6))


DRIVERS = {"exposure_growth_variance": "Exposure Growth", "premium_rate_variance": "Premium Rate", "claim_severity_variance": "Claim Severity"}


@query("root_cause_labelled", f"""WITH f AS ({FINANCE}), d AS (""" + " UNION ALL ".join(
    f"SELECT region, {i} AS place, '{c}' AS driver, '{label}' AS label, sum({c}) AS a FROM f GROUP BY region" for i, (c, label) in enumerate(DRIVERS.items())) + """)
SELECT region, row_number() OVER (PARTITION BY region ORDER BY abs(a) DESC, place) AS rank, driver, label, round(a, 2) AS amount,
 round(abs(a) / sum(abs(a)) OVER (PARTITION BY region) * 100, 2) AS contribution_pct, CASE WHEN a > 0 THEN 'favorable' WHEN a < 0 THEN 'unfavorable' ELSE 'neutral' END AS direction,
 round(sum(a) OVER (PARTITION BY region), 2) AS explained_variance, round(100000 - sum(a) OVER (PARTITION BY region), 2) AS unexplained_variance FROM d""")
def root_cause_labelled(spark, folder):
    return rootcause.labelled_drivers(_finance(spark, folder), keys=["region"], total_variance=100000.0)


@query("mode_tags", "WITH f AS (" + FINANCE + """), t AS (SELECT region, 'primary_variance_driver' AS "column", primary_variance_driver AS tag FROM f
 UNION ALL SELECT region, 'structural_vs_timing_flag', structural_vs_timing_flag FROM f UNION ALL SELECT region, 'recurring_flag', recurring_flag FROM f),
c AS (SELECT region, "column", tag, count(*) AS copies FROM t WHERE tag IS NOT NULL GROUP BY region, "column", tag),
r AS (SELECT *, row_number() OVER (PARTITION BY region, "column" ORDER BY copies DESC, tag) AS rk FROM c) SELECT region, "column", tag, copies FROM r WHERE rk = 1""")
def mode_tags(spark, folder):
    return rootcause.mode_tags(_finance(spark, folder), ["primary_variance_driver", "structural_vs_timing_flag", "recurring_flag"], ["region"])


@query("root_cause_corr", f"""WITH f AS ({FINANCE}), d AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS driver, round(corr({c}, revenue_actual), 4) AS r FROM f" for i, c in enumerate(DRIVERS)) + """)
SELECT row_number() OVER (ORDER BY abs(r) DESC, place) AS rank, driver, CASE place WHEN 0 THEN 'Exposure Growth Variance' WHEN 1 THEN 'Premium Rate Variance' ELSE 'Claim Severity Variance' END AS label,
 r AS correlation, round(abs(r) / sum(abs(r)) OVER () * 100, 2) AS contribution_pct, CASE WHEN r > 0 THEN 'favorable' WHEN r < 0 THEN 'unfavorable' ELSE 'neutral' END AS direction FROM d""")
def root_cause_corr(spark, folder):
    return rootcause.correlated_drivers(_finance(spark, folder), "revenue_actual")
