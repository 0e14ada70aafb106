"""Wide inputs prepared from the star schema, as SQL both engines read.

Tables are written as ``{name}``. These only prepare inputs; operators work on them.
"""

# Fact with its dimensions. Dimension sides are small and joined on unique keys.
STAR = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       l_shipdate, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       c_custkey, c_acctbal, c_mktsegment, n_name, r_name
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Orders with customer geography.
SALES = """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_custkey, c_acctbal, c_mktsegment, n_name, r_name
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# A customer card with gaps and typed-looking text, for profiling and rules.
CARD = """
SELECT c_custkey AS customer_id, c_name AS customer_name,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
       '+1 555-' || LPAD(CAST(c_custkey % 10000 AS STRING), 4, '0') AS contact,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 10 = 3 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 4 THEN 'n/a' ELSE c_mktsegment END AS channel,
       CASE c_nationkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
       CASE c_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'JP' END AS country,
       CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS active_flag,
       '202' || CAST(c_custkey % 4 AS STRING) || '-' || LPAD(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-'
             || LPAD(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS created_date,
       CASE WHEN c_custkey % 5 = 0 THEN 'unknown' WHEN c_custkey % 5 = 1 THEN 'true' ELSE CAST(c_custkey % 50 AS STRING) END AS mixed_code,
       c_acctbal AS account_balance, c_custkey % 101 AS discount_rate, c_nationkey AS nation_no,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'Customer ' || c_name || ' asked about an order of ' || c_mktsegment || ' goods' END AS notes
FROM {customer}
"""

# The finance view: actual, budget and drivers per order line, all in whole cents.
FINANCE = """
SELECT r_name AS region, n_name AS country, c_mktsegment AS business_unit, o_orderdate AS period_date, o_orderpriority AS priority,
       l_extendedprice AS revenue_actual, l_extendedprice + 7 * l_quantity - 150 AS revenue_budget,
       l_extendedprice - 11 * l_quantity AS revenue_prior_year,
       20 * l_quantity + 35 AS cost_actual, 21 * l_quantity + 10 AS cost_budget,
       CASE WHEN l_returnflag = 'R' THEN -1 * l_quantity ELSE l_quantity END AS exposure_growth_variance,
       CASE WHEN l_linestatus = 'O' THEN 3 * l_quantity ELSE -2 * l_quantity END AS premium_rate_variance,
       CASE WHEN o_orderpriority = '1-URGENT' THEN -5 * l_quantity ELSE 0 END AS claim_severity_variance,
       CASE WHEN l_quantity > 25 THEN 'S' ELSE 'T' END AS structural_vs_timing_flag,
       CASE WHEN l_returnflag = 'A' THEN 'Y' WHEN l_returnflag = 'R' THEN 'N' END AS recurring_flag,
       CASE WHEN l_returnflag = 'R' THEN 'claim_severity_variance' WHEN l_linestatus = 'O' THEN 'premium_rate_variance'
            ELSE 'exposure_growth_variance' END AS primary_variance_driver
FROM ({star}) s
"""

# The insurance view: additive inputs of the ratio formulas, in whole cents.
INSURANCE = """
SELECT r_name AS region, n_name AS country, c_mktsegment AS business_unit, o_orderdate AS reporting_date,
       l_extendedprice AS gross_written_premium, 40 * l_quantity AS ceded_reinsurance_premium,
       CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE l_extendedprice - 100 END AS earned_premium,
       10 * l_quantity AS reinsurance_earned_premium,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice WHEN l_returnflag = 'A' THEN l_extendedprice - 25 ELSE 60 * l_quantity END AS gross_claims_incurred,
       5 * l_quantity AS reinsurance_recovery, 90 * l_quantity AS acquisition_expense,
       30 * l_quantity AS claims_handling_expense, 45 * l_quantity AS administrative_expense,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS claims_reported_count, 1 AS policies_in_force,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS claims_paid_amount,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS claims_approved_count,
       CASE WHEN l_quantity > 12 THEN 1 ELSE 0 END AS renewed_policy_count, 1 AS renewal_due_policy_count,
       CASE WHEN l_quantity < 6 THEN 1 ELSE 0 END AS lapsed_policy_count,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice - 200 ELSE 0 END AS outstanding_claim_reserve,
       55 * l_quantity AS ibnr_reserve, l_extendedprice - 3 * l_quantity AS premium_collected
FROM ({star}) s
"""

FINANCE = FINANCE.replace("{star}", STAR)
INSURANCE = INSURANCE.replace("{star}", STAR)
