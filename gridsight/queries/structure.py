"""Hierarchies, drill-down cubes and chart aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsight.operators import charts, hierarchy as h, profile
from gridsight.plans.inputs import CARD, SALES
from gridsight.queries.profiling import COUNTS, card
from gridsight.queries.registry import prepared, query, table
from gridsight.queries.rules_quality import DIMENSIONS, SUITE_SQL, _dimensions, _suite

# Geography with gaps, a few conflicts and orphans on top of the clean hierarchy.
GEO = f"""SELECT *, CASE WHEN c_custkey % 300 = 7 THEN 'OTHER' ELSE r_name END AS loose_region,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE r_name END AS gappy_region,
 n_name || '-' || CAST(c_custkey % 40 AS STRING) AS city,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS amount FROM ({SALES}) s"""
EDGES = [("r_name", "n_name"), ("r_name", "c_mktsegment"), ("n_name", "city"), ("loose_region", "city"), ("gappy_region", "c_custkey"), ("c_mktsegment", "c_custkey")]


def _geo(spark, folder):
    return prepared(spark, folder, GEO)


def _edge_sql(i: int, parent: str, child: str) -> str:
    return (f"SELECT {i} AS edge, '{parent}' AS parent_column, '{child}' AS child_column, count(*) AS distinct_child_count, count(*) FILTER (np > 0) AS mapped_child_count, "
            f"count(*) FILTER (np > 1) AS violating_child_count FROM (SELECT {child}, count(DISTINCT {parent}) AS np FROM g WHERE {child} IS NOT NULL GROUP BY {child}) x")


def _edges_sql(edges) -> str:
    return f"""WITH g AS ({GEO}), e AS ({' UNION ALL '.join(_edge_sql(i, p, c) for i, (p, c) in enumerate(edges))}),
f AS (SELECT *, 1 - violating_child_count / distinct_child_count AS fd_consistency, mapped_child_count / distinct_child_count AS mapping_coverage FROM e),
edges AS (SELECT *, fd_consistency * mapping_coverage AS edge_confidence, CASE WHEN mapping_coverage < 0.9 THEN 'rejected' WHEN fd_consistency >= 0.98 THEN 'accepted'
 WHEN fd_consistency >= 0.9 THEN 'retained_with_warning' ELSE 'rejected' END AS status FROM f)"""


@query("fd_edges", f"{_edges_sql(EDGES)} SELECT * FROM edges")
def fd_edges(spark, folder):
    return h.dependency_edges(_geo(spark, folder), EDGES)


@query("fd_conflicts", f"""WITH g AS ({GEO}), v AS (SELECT DISTINCT city AS child, c_mktsegment AS parent FROM g WHERE city IS NOT NULL AND c_mktsegment IS NOT NULL),
w AS (SELECT child, count(*) AS parent_count FROM v GROUP BY child HAVING count(*) > 1 ORDER BY child LIMIT 5),
r AS (SELECT w.child, parent_count, parent, row_number() OVER (PARTITION BY w.child ORDER BY parent) AS rk FROM v JOIN w ON v.child = w.child)
SELECT child AS child_value, parent_count, string_agg(parent, '|' ORDER BY parent) AS parent_values FROM r WHERE rk <= 5 GROUP BY child, parent_count""")
def fd_conflicts(spark, folder):
    return h.dependency_conflicts(_geo(spark, folder), "c_mktsegment", "city").withColumn("parent_values", F.array_join("parent_values", "|"))


CANDIDATES = {
    "geographic": ["r_name", "n_name", "city"],
    "loose": ["loose_region", "n_name", "city"],
    "segment": ["r_name", "c_mktsegment", "c_custkey"],
    "broken": ["r_name", "no_such_level"],
}
CHAIN_EDGES = [("loose_region", "n_name"), ("n_name", "city"), ("r_name", "n_name"), ("r_name", "c_mktsegment"), ("c_mktsegment", "c_custkey")]
CHAINS = f"""{_edges_sql(CHAIN_EDGES)}, spots AS (SELECT * FROM (VALUES ('geographic', 0, 0, 'r_name', 'n_name'), ('geographic', 0, 1, 'n_name', 'city'),
 ('loose', 1, 0, 'loose_region', 'n_name'), ('loose', 1, 1, 'n_name', 'city'), ('segment', 2, 0, 'r_name', 'c_mktsegment'), ('segment', 2, 1, 'c_mktsegment', 'c_custkey'),
 ('broken', 3, 0, 'r_name', 'no_such_level')) t(chain, chain_order, spot, parent_column, child_column)),
j AS (SELECT s.*, COALESCE(e.status, 'rejected') AS status, edge_confidence FROM spots s LEFT JOIN edges e USING (parent_column, child_column)),
k AS (SELECT *, sum(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY spot) AS run FROM j),
runs AS (SELECT chain, run, min(spot) AS first_spot, count(*) AS edges, avg(edge_confidence) AS conf, bool_or(status = 'retained_with_warning') AS warned,
 string_agg(child_column, '>' ORDER BY spot) AS children, arg_min(parent_column, spot) AS top FROM k WHERE status <> 'rejected' GROUP BY chain, run),
best AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY edges DESC, first_spot) AS rk FROM runs),
chains AS (SELECT l.chain, l.chain_order, COALESCE(top || '>' || children, '') AS level_columns, COALESCE(conf, 0.0) AS average_confidence,
 CASE WHEN b.chain IS NULL THEN 'unresolved' WHEN warned THEN 'partial' ELSE 'accepted' END AS status, COALESCE(b.edges, -1) AS edges
 FROM (SELECT DISTINCT chain, chain_order FROM spots) l LEFT JOIN (SELECT * FROM best WHERE rk = 1) b ON l.chain = b.chain)"""


@query("hierarchy_chain", f"{CHAINS} SELECT chain, chain_order, level_columns, average_confidence, status FROM chains")
def hierarchy_chain(spark, folder):
    return h.hierarchy_chains(_geo(spark, folder), CANDIDATES).withColumn("level_columns", F.array_join("level_columns", ">"))


@query("hierarchy_select", f"{CHAINS} SELECT chain, level_columns, average_confidence, status FROM chains ORDER BY edges DESC, average_confidence DESC, chain_order LIMIT 1")
def hierarchy_select(spark, folder):
    return h.best_hierarchy(_geo(spark, folder), CANDIDATES).withColumn("level_columns", F.array_join("level_columns", ">"))


def _cube_sql(source: str, levels: list[str], metric: str) -> str:
    parts = []
    for d, level in enumerate(levels):
        above = levels[:d]
        path = " || ' / ' || ".join(f"CAST({c} AS VARCHAR)" for c in above) or "''"
        keys = ", ".join([*above, level])
        filled = " AND ".join(f"{c} IS NOT NULL" for c in above) or "true"
        over = f"OVER (PARTITION BY {', '.join(above)})" if above else "OVER ()"
        parts.append(f"""SELECT {d} AS level_depth, '{level}' AS level_column, {path} AS path, CAST({level} AS VARCHAR) AS label, value, "count", record_count FROM (
 SELECT {keys}, round(COALESCE(sum({metric}), 0), 2) AS value, count({metric}) AS "count", sum(count(*)) {over} AS record_count FROM g WHERE {filled} GROUP BY {keys}) x
 WHERE {level} IS NOT NULL AND "count" >= 5 AND record_count >= 5""")
    return f"WITH g AS ({source})\n" + "\nUNION ALL ".join(parts)


CUBE_LEVELS = ["gappy_region", "n_name", "c_mktsegment"]


def _flat(cubes):
    return cubes.withColumn("path", F.array_join(F.map_values("path"), " / ")).drop("metric", "next_level")


@query("drilldown_cube", _cube_sql(GEO, CUBE_LEVELS, "amount"))
def drilldown_cube(spark, folder):
    return _flat(h.drill_down_cubes(_geo(spark, folder), CUBE_LEVELS, "amount"))


@query("drilldown_lookup", f"SELECT * FROM ({_cube_sql(GEO, CUBE_LEVELS, 'amount')}) c WHERE level_depth = 2 AND path LIKE 'ASIA / %' AND path = 'ASIA / NATION_2'")
def drilldown_lookup(spark, folder):
    cubes = h.drill_down_cubes(_geo(spark, folder), CUBE_LEVELS, "amount")
    return _flat(h.drill_down(cubes, CUBE_LEVELS, {"gappy_region": "ASIA", "n_name": "NATION_2"}))


TEMPORAL = """SELECT o_totalprice, CAST(year(o_orderdate) AS VARCHAR) AS fiscal_year, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
 strftime(o_orderdate, '%Y-%m') AS month FROM orders"""


@query("drilldown_temporal", _cube_sql(TEMPORAL, ["fiscal_year", "quarter", "month"], "o_totalprice"))
def drilldown_temporal(spark, folder):
    levels = h.DRILL_PATHS["temporal"][:3]
    return _flat(h.drill_down_cubes(h.temporal_levels(table(spark, folder, "orders"), "o_orderdate"), levels, "o_totalprice"))


# --- Charts ------------------------------------------------------------------------

@query("chart_categorical", f"""SELECT n_name AS label, round(sum(o_totalprice), 2) AS value FROM ({SALES}) s GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 15""")
def chart_categorical(spark, folder):
    return charts.categorical_chart(prepared(spark, folder, SALES), "n_name", "o_totalprice", "sum")


@query("chart_stacked", f"""WITH s AS ({SALES}), top AS (SELECT n_name FROM s GROUP BY n_name ORDER BY avg(o_totalprice) DESC, n_name LIMIT 15)
SELECT n_name AS label, o_orderstatus AS series, (2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) / 100.0 AS value
 FROM s WHERE n_name IN (SELECT n_name FROM top) GROUP BY n_name, o_orderstatus""")
def chart_stacked(spark, folder):
    return charts.categorical_chart(prepared(spark, folder, SALES), "n_name", "o_totalprice", "mean", series="o_orderstatus")


@query("chart_monthly", """SELECT strftime(l_shipdate, '%Y-%m') AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_shipdate IS NOT NULL
 GROUP BY label ORDER BY label LIMIT 100""")
def chart_monthly(spark, folder):
    return charts.monthly_chart(table(spark, folder, "lineitem"), "l_shipdate", "l_extendedprice", "sum")


@query("chart_kpi", "SELECT 'Revenue' AS label, round(sum(o_totalprice), 2) AS value FROM orders")
def chart_kpi(spark, folder):
    return charts.kpi_tile(table(spark, folder, "orders"), "o_totalprice", "sum", "Revenue")


def histogram_sql(column: str, source: str, bins: str) -> str:
    edge = lambda i: f"(lo + {i} * (hi - lo) / bins)"
    return f"""WITH s AS (SELECT {bins} AS bins, min({column}) AS lo, max({column}) AS hi FROM {source}),
g AS (SELECT {column} AS x, CAST(least(floor(({column} - lo) * bins / (hi - lo)), bins - 1) AS INTEGER) AS g, lo, hi, bins FROM {source}, s WHERE {column} IS NOT NULL),
c AS (SELECT CASE WHEN x < {edge('g')} THEN g - 1 WHEN x >= {edge('(g + 1)')} AND g < bins - 1 THEN g + 1 ELSE g END AS bin, count(*) AS n FROM g GROUP BY bin)
SELECT CAST(b.bin AS INTEGER) AS bin, {edge('b.bin')} AS range_start, {edge('(b.bin + 1)')} AS range_end, COALESCE(n, 0) AS "count"
FROM (SELECT unnest(range(0, bins)) AS bin, lo, hi, bins FROM s) b LEFT JOIN c ON b.bin = c.bin"""


@query("chart_histogram", histogram_sql("l_extendedprice", "lineitem", "least(20, greatest(5, count(l_extendedprice) // 10))"))
def chart_histogram(spark, folder):
    return charts.histogram(table(spark, folder, "lineitem"), "l_extendedprice")


@query("chart_missing", f"""{COUNTS} SELECT "column" AS label, round(null_ratio * 100, 1) AS value FROM counts WHERE null_ratio > 0 ORDER BY null_ratio DESC, "column" LIMIT 15""")
def chart_missing(spark, folder):
    return charts.missing_chart(profile.column_counts(card(spark, folder)))


@query("chart_quality", f"{DIMENSIONS} SELECT dimension AS label, round(score * 100, 1) AS value FROM d WHERE score IS NOT NULL")
def chart_quality(spark, folder):
    return charts.quality_chart(_dimensions(spark, folder))


@query("chart_rule_violations", f"SELECT rule_key AS label, fail_count AS value FROM ({SUITE_SQL}) r WHERE error IS NULL AND fail_count > 0 ORDER BY fail_count DESC, rule_key LIMIT 15")
def chart_rule_violations(spark, folder):
    return charts.violations_chart(_suite(spark, folder))


@query("chart_box", """SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
 round(quantile_cont(o_totalprice, 0.75), 6) AS q75, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority""")
def chart_box(spark, folder):
    # Forced onto the bracketed quantiles, the form large tables take.
    box = charts.box_chart(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority")
    return box.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75")})


@query("chart_heatmap", f"SELECT r_name AS x, c_mktsegment AS y, round(sum(o_totalprice), 2) AS value FROM ({SALES}) s GROUP BY r_name, c_mktsegment")
def chart_heatmap(spark, folder):
    return charts.heatmap_chart(prepared(spark, folder, SALES), "r_name", "c_mktsegment", "o_totalprice")


@query("chart_scatter", """SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), l_orderkey, l_linenumber LIMIT 5000""")
def chart_scatter(spark, folder):
    return charts.scatter_chart(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])
