import pytest

from gridsight.functions.conditions import ConditionError, condition, names_in
from gridsight.operators import hierarchy as h, profile, quality, readiness, refine, rules
from gridsight.plans import kpis as K


def table(spark):
    return spark.createDataFrame([("a", "5", "2024-01-05", "2024-01-01", "x"), ("b", "-1", "2024-01-01", "2024-01-02", None), ("b", "oops", None, "2024-01-03", "y"),
                                  (None, "9", "2024-02-01", "2024-01-04", None)], "k string, n string, d1 string, d2 string, v string")


def run(spark, *raw, roles=None):
    return {r["rule_key"]: r for r in rules.evaluate_rules(table(spark), rules.load_rules(list(raw)), roles).collect()}


def test_rules(spark):
    got = run(spark,
              {"rule_key": "nn", "type": "non_null", "target_column": "v"},
              {"rule_key": "uq", "type": "expected_unique", "target_column": "k"},
              {"rule_key": "uv", "type": "expected_unique", "target_column": "v"},
              {"rule_key": "re", "type": "regex_match", "target_column": "d1", "pattern": "2024-01"},
              {"rule_key": "rg", "type": "numeric_range", "target_column": "n", "min_value": 0, "max_value": 9, "inclusive_max": False},
              {"rule_key": "cc", "type": "column_comparison", "left_column": "d1", "operator": ">=", "right_column": "d2"},
              {"rule_key": "cr", "type": "conditional_required", "condition_column": "k", "condition_value": "b", "required_column": "v"},
              {"rule_key": "dr", "type": "date_range", "target_column": "d1", "max_date": "2024-01-31"},
              {"rule_key": "role", "type": "numeric_range", "target_role": "monetary_amount", "min_value": 0},
              {"rule_key": "gone", "type": "non_null", "target_column": "zzz"},
              roles={"monetary_amount": "n"})
    counts = {k: (r["records_checked"], r["pass_count"], r["fail_count"]) for k, r in got.items()}
    assert counts == {"nn": (4, 2, 2), "uq": (4, 3, 1), "uv": (4, 3, 1), "re": (3, 2, 1), "rg": (3, 1, 2), "cc": (3, 2, 1), "cr": (2, 1, 1),
                      "dr": (3, 2, 1), "role": (3, 2, 1), "gone": (0, 0, 0)}
    assert got["gone"]["error"] == "Column not found" and got["gone"]["score"] == 0.0


def test_empty_table_scores(spark):
    empty = table(spark).limit(0)
    every = rules.load_rules([{"rule_key": "nn", "type": "non_null", "target_column": "k"}, {"rule_key": "uq", "type": "expected_unique", "target_column": "k"},
                              {"rule_key": "rg", "type": "numeric_range", "target_column": "n", "min_value": 0}])
    assert {r["rule_key"]: r["score"] for r in rules.evaluate_rules(empty, every).collect()} == {"nn": 0.0, "uq": 0.0, "rg": 1.0}


def test_mined_invariants(spark):
    df = spark.range(100).selectExpr("id * 1.0 as low", "id * 2.0 + 1 as high", "id * 1.0 as same", "id % 2 as flag", "100 - id as customer_id")
    got = [(r["left_column"], r["operator"], r["right_column"]) for r in rules.mine_invariants(df, top=None).collect()]
    assert set(got) == {("low", "<=", "high"), ("low", "==", "same"), ("high", ">=", "same")}
    assert rules.mine_invariants(df.limit(20)).count() == 0


def test_conditions_are_restricted(spark):
    assert names_in("a > 3 AND NOT (b <= 2 * abs(c))") == {"a", "b", "c"}
    for text in ("a", "exp(a) > 1", "a > 1; drop", "a > 'x'", "abs"):
        with pytest.raises(ConditionError):
            names_in(text)
    with pytest.raises(ConditionError):
        condition("z > 1", ["a"])


def test_alerts(spark):
    kpis = spark.createDataFrame([("x", 105.0, 85.0), ("y", 50.0, 60.0)], "g string, loss_ratio_actual double, renewal_rate_actual double")
    got = [(r["g"], r["rule_id"], r["severity"]) for r in rules.kpi_alerts(kpis, ["g"], K.ALERT_RULES).collect()]
    assert got == [("x", "BR001", "critical"), ("x", "BR007", "healthy"), ("y", "BR006", "critical"), ("y", "BR003", "healthy")]


def test_not_assessable_is_never_zero(spark):
    counts = profile.column_counts(table(spark)).selectExpr("*", "column as normalized_key")
    none = rules.evaluate_rules(table(spark), [])
    dims = {r["dimension"]: r for r in quality.quality_dimensions(counts, none).collect()}
    assert len(dims) == 10 and all(r["score"] is None and r["status"] == "not_assessable" for r in dims.values())
    some = quality.quality_dimensions(counts, none, mandatory=["v"])
    assert quality.overall_quality(some).first()["overall_score"] == 0.5
    assert quality.overall_quality(quality.quality_dimensions(counts, none)).first()["overall_score"] is None


def test_readiness(spark):
    df = spark.range(200).selectExpr("id as order_id", "id * 1.25 as amount", "id % 7 * 1.5 as cost", "concat('r', id % 4) as region", "concat('s', id % 3) as status",
                                     "concat('c', id % 5) as channel", "concat('2024-01-', lpad(1 + id % 28, 2, '0')) as order_date")
    described = refine.described_columns(profile.column_profiles(df))
    counts = profile.column_counts(df).selectExpr("*", "column as normalized_key")
    dims = quality.quality_dimensions(counts, rules.evaluate_rules(df, []), mandatory=["amount"], unique=["order_id"])
    got = {r["assessment"]: r for r in readiness.readiness(described, dims, 1.0).collect()}
    # completeness 20, metrics 15, dimensions 15, grain 10, temporal 10
    assert got["analytics"]["score"] == 70.0 and got["analytics"]["status"] == "partially_ready"
    # completeness 20, six of seven columns, 200 rows 5, cardinality, uniqueness 10
    assert got["ml"]["task_score"] is None and 40 < got["ml"]["score"] < 65
    assert got["llm"]["score"] == 80.0
    leaky = spark.createDataFrame([("order_id", "high"), ("amount", "medium")], "column string, usefulness string")
    assert readiness.readiness(described, dims, 1.0, features=leaky).where("assessment = 'ml'").first()["score"] < got["ml"]["score"]


def fd(spark, pairs, parent="p", child="c"):
    return h.dependency_edges(spark.createDataFrame(pairs, "p string, c string"), [(parent, child)]).first()


def test_dependency_cases(spark):
    clean = fd(spark, [("A", f"a{i}") for i in range(2)] * 3 + [("B", "b1"), ("C", None)])
    assert (clean["fd_consistency"], clean["status"], clean["distinct_child_count"]) == (1.0, "accepted", 3)
    noisy = fd(spark, [("X", f"c{i}") for i in range(95)] + [("Y", f"c{i}") for i in range(5)])
    assert noisy["violating_child_count"] == 5 and noisy["status"] == "retained_with_warning" and abs(noisy["fd_consistency"] - (1 - 5 / 95)) < 1e-12
    orphan = fd(spark, [("X", f"c{i}") for i in range(8)] + [(None, "c8"), (None, "c9")])
    assert orphan["mapping_coverage"] == 0.8 and orphan["fd_consistency"] == 1.0 and orphan["status"] == "rejected"
    nothing = fd(spark, [("X", None)])
    assert (nothing["fd_consistency"], nothing["mapping_coverage"], nothing["status"]) == (1.0, 0.0, "rejected")


def test_cube_adds_up(spark):
    df = spark.range(600).selectExpr("concat('r', id % 3) as region", "concat('n', id % 12) as nation", "id * 1.0 as amount")
    cubes = h.drill_down_cubes(df, ["region", "nation"], "amount")
    top = {r["label"]: r["value"] for r in cubes.where("level_depth = 0").collect()}
    for name, value in top.items():
        below = h.drill_down(cubes, ["region", "nation"], {"region": name}).collect()
        assert sum(r["value"] for r in below) == value and all(r["record_count"] == 200 for r in below)
    small = h.drill_down_cubes(df.limit(8), ["region", "nation"], "amount")
    assert small.where("level_depth = 1").count() == 0
    with pytest.raises(h.DrillDownError):
        h.drill_down(cubes, ["region", "nation"], {"city": "x"})
    with pytest.raises(h.DrillDownError):
        h.drill_down(cubes, ["region", "nation"], {"region": "r0", "nation": "n0"})
