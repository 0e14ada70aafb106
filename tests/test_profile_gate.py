import math

import numpy as np
from pyspark.sql import functions as F

from gridsight.operators import gate, profile, refine
from gridsight.sources import tables


def rows(df, key="column"):
    return {r[key]: r for r in df.collect()}


def payments(spark):
    data = [(f"T{i:03d}", f"2024-01-{1 + i % 28:02d}", f"{10 + i}.50", ["USD", "EUR", "GBP"][i % 3], ["approved", "declined"][i % 4 == 0],
             None if i % 4 else "no funds", ["US", "GB", "DE"][i % 3], str(i % 2), f"user{i}@mail.com", f"+1 555-{1000 + i}") for i in range(60)]
    return spark.createDataFrame(data, "txn_id string, auth_date string, amount string, currency string, auth_status string, decline_reason string, "
                                 "country string, fraud_flag string, email string, contact string")


def test_types_and_roles(spark):
    got = rows(refine.described_columns(profile.column_profiles(payments(spark))))
    types = {c: r["refined_type"] for c, r in got.items()}
    assert types == {"txn_id": "identifier", "auth_date": "date", "amount": "decimal", "currency": "currency_code", "auth_status": "categorical",
                     "decline_reason": "text", "country": "country_code", "fraud_flag": "boolean", "email": "email", "contact": "phone"}
    assert got["txn_id"]["is_identifier"] and got["txn_id"]["role"] == "identifier"
    assert got["txn_id"]["semantic_type"] == "transaction_identifier"
    assert got["amount"]["role"] == "metric" and got["amount"]["semantic_type"] == "monetary_amount"
    assert got["auth_date"]["semantic_type"] == "authorization_date"
    assert got["fraud_flag"]["semantic_type"] == "fraud_flag"
    assert got["decline_reason"]["semantic_type"] == "decline_reason"


def test_decimal_is_no_identifier(spark):
    df = spark.range(50).select((F.col("id") * 1.37 + 0.11).alias("price"), F.col("id").alias("order_id"))
    got = rows(refine.described_columns(profile.column_profiles(df)))
    assert not got["price"]["is_identifier"]
    assert got["order_id"]["is_identifier"]


def test_categories_and_domain(spark):
    described = refine.described_columns(profile.column_profiles(payments(spark)))
    got = rows(refine.data_categories(described, "payments"))
    assert got["country"]["primary_category"] == "Geographic Data"
    assert got["auth_date"]["primary_category"] == "Time Series Data"
    assert got["fraud_flag"]["primary_category"] == "Risk Data"
    domains = rows(refine.secondary_domains(described, "payments"), "domain")
    assert domains["Authorization"]["rank"] == 1
    assert 0 <= domains["Clearing"]["score"] <= 1


def test_profile_of_nulls_and_single_value(spark):
    df = spark.createDataFrame([(None, "5"), (None, "5")], "empty string, one string")
    got = rows(profile.column_profiles(df))
    assert got["empty"]["non_null_count"] == 0 and got["empty"]["cardinality_ratio"] == 0.0 and got["empty"]["mean"] is None
    assert got["one"]["distinct_count"] == 1 and got["one"]["duplicate_count"] == 1 and got["one"]["std_dev"] == 0.0
    types = rows(refine.refined_types(profile.column_profiles(df)))
    assert types["empty"]["refined_type"] == "unknown"


def test_numbers_are_strict(spark):
    df = spark.createDataFrame([("1d",), ("1.0f",), ("NaN",), ("2",), ("3",), ("1e2",), ("4",)], "x string")
    got = rows(profile.parse_ratios(df))["x"]
    assert math.isclose(got["numeric_parse_ratio"], 4 / 7)
    years = spark.createDataFrame([("123456",), ("2024",), ("2024-01-02",), ("01/02/2024",)], "x string")
    assert rows(profile.parse_ratios(years))["x"]["datetime_parse_ratio"] == 0.5


def test_bracketed_quantiles(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 613 / 7.0).alias("x"), (F.col("id") % 3).alias("k"))
    from gridsight.functions.quantiles import quantiles
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    key = lambda r: (r["k"], r["prob"])
    got = [(key(r), round(r["value"], 9)) for r in sorted(quantiles(df, ["x"], probs, ["k"]).collect(), key=key)]
    groups = {k: [i * 7919 % 613 / 7.0 for i in range(1000) if i % 3 == k] for k in range(3)}
    assert got == [((k, p), round(float(np.quantile(groups[k], p)), 9)) for k in range(3) for p in probs]
    whole = {r["prob"]: r["value"] for r in quantiles(df, ["x", "k"], probs).where("column = 'x'").collect()}
    assert all(abs(whole[p] - np.quantile(sum(groups.values(), []), p)) < 1e-9 for p in probs)


def test_normalised_keys():
    assert profile.normalised_keys(["Order ID", "order-id", "Total ($)", "***"]) == ["order_id", "order_id_1", "total", "column"]


def test_gate_scores(spark):
    clean = spark.range(40).select(F.col("id"), F.concat(F.lit("NAME"), F.col("id") % 5).alias("name"))
    got = rows(gate.quality_gate(clean), "check")
    assert got["missing_values"]["score"] == 20.0 and got["missing_values"]["decision"] == "PASS"
    assert math.isclose(got["missing_values"]["dataset_score"], 100.0)
    bad = spark.range(40).select(F.lit(None).cast("string").alias("a"), F.lit("n/a").alias("b"))
    got = rows(gate.quality_gate(bad), "check")
    assert got["missing_values"]["score"] == 0.0
    assert got["empty_columns"]["score"] == 5.0
    assert got["corrupted_values"]["score"] == 0.0 and got["corrupted_values"]["warning"]
    assert got["duplicate_rows"]["score"] == round(5 * (1 - 39 / 40), 2)


def test_gate_mixed_types(spark):
    df = spark.createDataFrame([("123",), ("456",), ("abc",), ("true",), ("2024-01-01",), ("7.5",)], "x string")
    got = gate.type_consistency(gate.column_checks(df)).first()
    assert (got["as_number"], got["as_boolean"], got["as_time"], got["as_text"]) == (3, 1, 1, 1) and got["consistency"] == 0.5


def test_casing(spark):
    df = spark.createDataFrame([("ABC",), ("abc",), ("Abc Def",), ("ABc",), ("A",), ("Ab-Cd 9",), ("123",), (" ",), (None,)], "x string")
    got = gate.column_checks(df).first()
    assert (got["case_upper"], got["case_lower"], got["case_title"], got["case_mixed"]) == (2, 1, 2, 2)
    assert got["solid_strings"] == 7


def test_guards(spark):
    import pytest
    empty = spark.createDataFrame([], "a int")
    assert tables.table_guard(empty).first()["verdict"] == "EMPTY"
    with pytest.raises(tables.EmptyTableError):
        tables.require_table(empty)
    with pytest.raises(tables.TableTooLargeError):
        tables.require_table(spark.range(10), max_rows=5)
    assert tables.require_table(spark.range(5), max_rows=5).count() == 5


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,name,note\n1,NA,ok\n2,Ann,null\n3,,n/a\n")
    got = tables.read_text_columns(spark, str(path)).collect()
    assert [tuple(r) for r in got] == [("1", None, "ok"), ("2", "Ann", None), ("3", None, None)]
    assert dict(tables.read_typed(spark, str(path)).dtypes)["id"] == "int"


def test_sinks_replace_one_run(spark, tmp_path):
    from gridsight.sources.sinks import read_result, write_result
    root = str(tmp_path / "results")
    write_result(spark.range(3).toDF("v"), root, "quality_results", "a")
    write_result(spark.range(5).toDF("v"), root, "quality_results", "b")
    write_result(spark.range(2).toDF("v"), root, "quality_results", "a")
    assert read_result(spark, root, "quality_results", "a").count() == 2
    assert read_result(spark, root, "quality_results").count() == 7
