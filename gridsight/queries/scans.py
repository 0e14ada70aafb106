"""Scans, guards, metadata, result tables and ad-hoc selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridsight.functions.scale import shared_folder
from gridsight.operators import profile, query as q
from gridsight.plans.inputs import CARD, SALES, STAR
from gridsight.queries.registry import prepared, query, table
from gridsight.sources import sinks, tables

NULLS = ", ".join(f"'{t}'" for t in tables.NULL_TOKENS)


CARD_COLUMNS = ["customer_id", "customer_name", "email", "contact", "segment", "channel", "currency", "country", "active_flag", "created_date",
                "mixed_code", "account_balance", "discount_rate", "nation_no", "notes"]


@query("scan_na_normalise", f"WITH card AS ({CARD}) SELECT " + ", ".join(
    f"CASE WHEN CAST({c} AS VARCHAR) NOT IN ({NULLS}) THEN CAST({c} AS VARCHAR) END AS {c}" for c in CARD_COLUMNS) + " FROM card")
def scan_na_normalise(spark, folder):
    # The card as CSV files in the shared folder, read back as text.
    path = f"{shared_folder(spark)}/gridsight_csv/{uuid.uuid4().hex}"
    prepared(spark, folder, CARD).select(*CARD_COLUMNS).write.csv(path, header=True, quote='"', escape='"')
    return tables.read_text_columns(spark, path)


@query("scan_typed", """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total
FROM events GROUP BY event_type""")
def scan_typed(spark, folder):
    tables.read_typed(spark, f"{folder.rstrip('/')}/events.parquet", view="typed_events")
    return spark.sql("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, "
                     "round(sum(value), 2) AS total FROM typed_events GROUP BY event_type")


@query("dataset_guard", """
SELECT count(*) AS row_count, 11 AS column_count, false AS no_columns, count(*) = 0 AS no_rows,
       count(*) > 200000 AS too_many_rows, false AS too_many_columns,
       CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) > 200000 THEN 'TOO_LARGE' ELSE 'OK' END AS verdict
FROM lineitem""")
def dataset_guard(spark, folder):
    return tables.table_guard(table(spark, folder, "lineitem"), max_rows=200_000, max_columns=200)


@query("dataset_metadata", """
WITH head AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5), n AS (SELECT count(*) AS row_count FROM customer)
SELECT 0 AS position, 'c_custkey' AS "column", 'bigint' AS data_type, string_agg(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_custkey) AS sample_values, (SELECT row_count FROM n) AS row_count, 5 AS column_count FROM head
UNION ALL SELECT 1, 'c_name', 'string', string_agg(c_name, '|' ORDER BY c_custkey), (SELECT row_count FROM n), 5 FROM head
UNION ALL SELECT 2, 'c_nationkey', 'int', string_agg(CAST(c_nationkey AS VARCHAR), '|' ORDER BY c_custkey), (SELECT row_count FROM n), 5 FROM head
UNION ALL SELECT 3, 'c_acctbal', 'double', string_agg(CAST(c_acctbal AS VARCHAR), '|' ORDER BY c_custkey), (SELECT row_count FROM n), 5 FROM head
UNION ALL SELECT 4, 'c_mktsegment', 'string', string_agg(c_mktsegment, '|' ORDER BY c_custkey), (SELECT row_count FROM n), 5 FROM head""")
def dataset_metadata(spark, folder):
    meta = tables.table_metadata(table(spark, folder, "customer"), ["c_custkey"])
    return meta.withColumn("sample_values", F.array_join("sample_values", "|"))


@query("profile_sink_roundtrip", """
WITH c AS (SELECT c_mktsegment AS value FROM customer)
SELECT 'c_mktsegment' AS "column", count(*) AS row_count, count(DISTINCT value) AS distinct_count, 'run-1' AS run_id FROM c""")
def profile_sink_roundtrip(spark, folder):
    counts = profile.column_counts(table(spark, folder, "customer").select("c_mktsegment"))
    root = f"{shared_folder(spark)}/gridsight_results/{uuid.uuid4().hex}"
    sinks.write_result(counts.select("column", "row_count", "distinct_count"), root, "column_profiles", "run-1")
    return sinks.read_result(spark, root, "column_profiles", "run-1")


@query("kpi_select", "SELECT o_orderkey, o_totalprice, round(o_totalprice * 0.5, 3) AS half, o_orderstatus FROM orders")
def kpi_select(spark, folder):
    return q.kpi_data(table(spark, folder, "orders"),
                      ["o_orderkey", "o_totalprice", "round(o_totalprice * 0.5, 3) AS half", "o_orderstatus"])


@query("kpi_filter", f"""
SELECT customer_id, currency, country FROM ({CARD}) c
WHERE currency = 'USD' AND country IN ('US', 'DE') AND segment IS NULL""")
def kpi_filter(spark, folder):
    return q.kpi_data(prepared(spark, folder, CARD), ["customer_id", "currency", "country"],
                      filters={"currency": "USD", "country": ["US", "DE"], "segment": None})


@query("kpi_group_sort_limit", f"""
SELECT n_name, c_mktsegment, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders
FROM ({SALES}) s WHERE o_orderstatus = 'F' GROUP BY n_name, c_mktsegment
ORDER BY revenue DESC, n_name, c_mktsegment LIMIT 20""")
def kpi_group_sort_limit(spark, folder):
    return q.kpi_data(prepared(spark, folder, SALES), ["round(sum(o_totalprice), 2) AS revenue", "count(*) AS orders"],
                      filters={"o_orderstatus": "F"}, group_by=["n_name", "c_mktsegment"],
                      order_by=[F.desc("revenue"), F.asc("n_name"), F.asc("c_mktsegment")], limit=20)


@query("period_filter", f"""
SELECT o_orderkey, c_mktsegment, r_name FROM ({SALES}) s
WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01' AND r_name = 'ASIA'
UNION ALL SELECT o_orderkey, c_mktsegment, r_name FROM ({SALES}) s
WHERE o_orderdate >= TIMESTAMP '1997-04-01' AND o_orderdate < TIMESTAMP '1998-04-01' AND r_name = 'EUROPE'""")
def period_filter(spark, folder):
    sales = prepared(spark, folder, SALES)
    columns = ["o_orderkey", "c_mktsegment", "r_name"]
    third = q.period_filter(sales, "o_orderdate", year=1996, quarter=3, r_name="ASIA").select(*columns)
    fiscal = q.period_filter(sales, "o_orderdate", fiscal_year=1998, fiscal_start_month=4, r_name="EUROPE").select(*columns)
    return third.unionByName(fiscal)


@query("value_distribution", """
SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count DESC, value LIMIT 20""")
def value_distribution(spark, folder):
    return q.value_distribution(table(spark, folder, "part"), "p_brand")
