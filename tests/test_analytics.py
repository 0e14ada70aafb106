import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsight.functions.tails import two_sided_p
from gridsight.operators import anomaly, catalog, charts, cluster, importance, kpi, learn, neighbors, rootcause, segment, stats, timeseries as ts


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def budget(spark):
    return frame(spark, region=["EMEA", "APAC", "Africa"], actual=[1000.0, 800.0, 600.0], budget=[1100.0, 750.0, 650.0])


def test_arithmetic(spark):
    df = budget(spark)
    assert kpi.aggregate(df, "actual").first()["value"] == 2400
    assert kpi.aggregate(df, "actual", "mean").first()["value"] == 800
    assert kpi.aggregate(df, "actual", "median").first()["value"] == 800
    with pytest.raises(ValueError):
        kpi.aggregate(df, "actual", "mode")
    row = kpi.variance(df, "actual", "budget").first()
    assert (row["variance_amount"], row["variance_pct"], row["direction"]) == (-100.0, -4.0, "unfavorable")
    assert abs(sum(r["contribution_pct"] for r in kpi.contribution(df, "actual", "region").collect()) - 100) < 0.05
    ranked = kpi.rank_rows(df, "actual", "region", top=2).orderBy("rank").collect()
    assert [(r["rank"], r["label"]) for r in ranked] == [(1, "EMEA"), (2, "APAC")]
    groups = {r["label"]: r["extreme"] for r in kpi.compare_groups(df, "actual", "region").collect()}
    assert groups == {"EMEA": "highest", "APAC": None, "Africa": "lowest"}


def test_lower_is_better(spark):
    df = frame(spark, a=[83.71, 105.0, 1.0], b=[83.94, 100.0, 0.0])
    got = df.select(*kpi.variance_columns(F.col("a"), F.col("b"), False)).collect()
    assert [r["direction"] for r in got] == ["favorable", "unfavorable", "unfavorable"]
    assert got[2]["variance_pct"] is None


def test_growth_and_trend(spark):
    df = frame(spark, m=["2024-01", "2024-02", "2024-03", "2024-04"], d=[f"2024-0{i}-01" for i in range(1, 5)], v=[100.0, 110.0, 120.0, 130.0])
    assert [r["growth_pct"] for r in kpi.growth(df, "m", "v").orderBy("period").collect()] == [None, 10.0, 9.09, 8.33]
    row = kpi.trend(df, "d", "v").first()
    assert (row["direction"], row["data_points"], row["overall_change_pct"]) == ("increasing", 4, 30.0)
    flat = frame(spark, d=["2024-01-01", "2024-02-01"], v=[5.0, 5.0])
    assert kpi.trend(flat, "d", "v").first()["overall_change_pct"] == 0.0


def test_charts(spark):
    df = frame(spark, d=["a", "a", "b", None], v=["1", "x", None, "7"])
    got = {r["label"]: r["value"] for r in charts.categorical_chart(df, "d", "v").collect()}
    assert got == {"a": 1.0, "b": 0.0}
    hist = charts.histogram(spark.range(100).toDF("x"), "x").orderBy("bin").collect()
    counts, edges = np.histogram(np.arange(100), bins=10)
    assert [r["count"] for r in hist] == counts.tolist() and np.allclose([r["range_start"] for r in hist], edges[:-1])
    same = charts.histogram(frame(spark, x=[4.0, 4.0, 4.0]), "x").collect()
    assert sum(r["count"] for r in same) == 3 and len(same) == 5
    assert charts.histogram(spark.range(0).toDF("x"), "x").count() == 0


def test_root_cause(spark):
    df = frame(spark, a_variance=[1.0, 2.0], b_variance=[-10.0, -4.0], c=["S", "S"])
    got = rootcause.labelled_drivers(df, ["a_variance", "b_variance", "missing"], total_variance=0.0).orderBy("rank").collect()
    assert [(r["driver"], r["amount"], r["direction"]) for r in got] == [("b_variance", -14.0, "unfavorable"), ("a_variance", 3.0, "favorable")]
    assert got[0]["unexplained_variance"] == 11.0 and abs(sum(r["contribution_pct"] for r in got) - 100) < 0.05
    names = spark.createDataFrame([], "revenue_actual double, revenue_budget double, price_variance double, units double")
    assert rootcause.driver_candidates(names, "revenue_actual") == ["price_variance"]
    assert rootcause.driver_candidates(names.drop("price_variance"), "revenue_actual") == ["units"]


def test_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    data = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(size=200), "z": np.round(rng.normal(size=200), 1)})
    df = spark.createDataFrame(data)
    got = {(r["column_a"], r["column_b"]): r for r in stats.pearson(df, ["x", "y", "z"]).collect()}
    assert got[("x", "y")]["correlation"] == round(np.corrcoef(data.x, data.y)[0, 1], 4) and got[("x", "y")]["p_value"] == 0.0
    ranks = data.rank()
    rho = {(r["column_a"], r["column_b"]): r["correlation"] for r in stats.spearman(df, ["x", "y", "z"], with_p=False).collect()}
    assert all(abs(rho[(a, b)] - np.corrcoef(ranks[a], ranks[b])[0, 1]) < 1e-4 for a, b in rho)


def test_p_values():
    # Student t: r = 0.5 on 10 rows is t = 1.632993 with 8 degrees of freedom.
    assert math.isclose(two_sided_p(0.5, 10), 0.1411, abs_tol=1e-4)
    assert math.isclose(two_sided_p(0.0, 30), 1.0) and two_sided_p(1.0, 5) == 0.0 and two_sided_p(0.4, 2) is None


def test_contingency_shares(spark):
    df = frame(spark, a=["x", "x", "y", None], b=["p", "q", "p", "p"])
    got = {(r["value_a"], r["value_b"]): r["probability"] for r in stats.contingency(df, ["a", "b"]).collect()}
    assert got == {("x", "p"): 0.5, ("x", "q"): 0.5, ("y", "p"): 1.0}


def daily(spark, values):
    start = dt.date(2024, 1, 1)
    return frame(spark, ds=[start + dt.timedelta(days=i) for i in range(len(values))], y=[float(v) for v in values])


def test_forecasts(spark):
    line = ts.linear_trend(daily(spark, range(10, 20))).orderBy("h").collect()
    assert [r["yhat"] for r in line] == [20.0, 21.0, 22.0, 23.0, 24.0, 25.0] and line[0]["ds"] == dt.date(2024, 1, 11) and line[0]["trend_direction"] == "increasing"
    mean = ts.moving_average(daily(spark, [1, 2, 3, 4])).first()
    assert mean["yhat"] == 3.0 and mean["yhat_upper"] == round(3 + math.sqrt(2 / 3), 2)
    values = [5.0, 7.0, 6.0, 9.0, 4.0, 8.0]
    level = values[0]
    for v in values[1:]:
        level = 0.3 * v + 0.7 * level
    assert ts.exponential_smoothing(daily(spark, values)).first()["yhat"] == round(level, 2)
    assert ts.linear_trend(daily(spark, [1, 2, 3])).count() == 0
    assert ts.frequency(daily(spark, [1, 2, 3])).first()["frequency"] == "D"
    wave = [100 + 20 * math.sin(2 * math.pi * i / 12) for i in range(48)]
    months = frame(spark, ds=[dt.date(2020 + i // 12, 1 + i % 12, 1) for i in range(48)], y=wave)
    ahead = ts.seasonal_forecast(months).orderBy("ds").collect()
    assert len(ahead) == 6 and all(abs(r["yhat"] - (100 + 20 * math.sin(2 * math.pi * i / 12))) < 8 for i, r in enumerate(ahead))


def spiked(spark, n=300):
    rng = np.random.default_rng(5)
    a, b = rng.normal(100, 5, n), rng.normal(10, 1, n)
    a[7] = 400.0
    a[11], b[13] = np.nan, np.nan
    return frame(spark, id=list(range(n)), a=a, b=b), a, b


def test_deviation_outliers(spark):
    df, a, b = spiked(spark)
    a, b = np.where(np.isnan(a), np.nanmedian(a), a), np.where(np.isnan(b), np.nanmedian(b), b)
    z = np.maximum(abs((a - a.mean()) / a.std()), abs((b - b.mean()) / b.std()))
    got = anomaly.zscore(df, ["a", "b"], ["id"]).collect()
    assert {r["id"] for r in got} == set(np.flatnonzero(z > 3)) and got[0]["id"] == 7
    assert anomaly.iqr(df, ["a", "b"], ["id"]).first()["id"] == 7
    assert anomaly.modified_zscore(df, ["a", "b"], ["id"]).first()["id"] == 7
    flat = frame(spark, id=[1, 2, 3], a=[5.0, 5.0, 5.0])
    assert anomaly.zscore(flat, ["a"], ["id"]).count() == 0 and anomaly.iqr(flat, ["a"], ["id"]).count() == 0


def test_isolation_forest(spark):
    df, *_ = spiked(spark)
    nodes, scaling = anomaly.fit_forest(df, ["a", "b"], "id", trees=50)
    scored = anomaly.score_forest(df, nodes, scaling, ["id"])
    flagged = anomaly.forest_anomalies(scored)
    assert flagged.first()["id"] == 7 and abs(flagged.count() - 15) <= 1
    with pytest.raises(ValueError):
        anomaly.score_forest(df.drop("b"), nodes, scaling)


def test_one_class_boundary(spark):
    df, *_ = spiked(spark)
    got = anomaly.one_class_boundary(df, ["a", "b"], ["id"], rounds=10)
    assert 7 in {r["id"] for r in got.collect()} and abs(got.count() - 15) <= 1


def test_wave_sums_equal_doubles():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=(2500, 3)), rng.normal(size=(100, 3)) * 1e6])
    omega, phase, weights = rng.normal(size=(3, 16)), rng.uniform(0, 2 * np.pi, 16), rng.normal(size=16)
    phi = np.sqrt(2 / 16) * np.cos(values @ omega + phase)
    margins = np.sort(phi @ weights)
    for offset in (np.inf, -np.inf, *(margins[i:i + 2].mean() for i in np.flatnonzero(np.diff(margins) > 1e-4)[[10, 500]])):
        below, inside = anomaly.wave_sums(values, omega, phase, weights, offset)
        short = phi @ weights < offset
        assert inside == short.sum() and np.allclose(below, phi[short].sum(axis=0), atol=1e-3)


def test_lof_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 2)), np.repeat([[1.5, 1.5]], 60, axis=0), rng.uniform(-9, 9, size=(20, 2))])
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1, kind="stable")[:, :20]
    d = np.take_along_axis(apart, near, 1)
    density = 1 / (np.maximum(d[:, -1][near], d).mean(1) + 1e-10)
    expected = density[near].mean(1) / density
    df = frame(spark, id=list(range(len(x))), a=x[:, 0], b=x[:, 1])
    got = neighbors.local_outlier_factor(df, ["a", "b"], ["id"]).toPandas().sort_values("id")["lof"].to_numpy()
    assert np.allclose(got, expected, rtol=1e-6)


def test_infinity_is_no_number(spark):
    values = [float(i % 7) for i in range(100)] + [500.0, float("inf"), float("-inf"), float("nan")]
    df = frame(spark, id=list(range(104)), a=values, t=[str(v) for v in values[:101]] + ["1e999", "-1e999", "x"])
    for name in ("a", "t"):
        for flagged in (anomaly.zscore(df, [name], ["id"]), anomaly.iqr(df, [name], ["id"]), anomaly.modified_zscore(df, [name], ["id"])):
            assert [r["id"] for r in flagged.collect()] == [100]


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 2)), rng.normal(size=(80, 2)) * 0.05 + 3, np.repeat([[-3.0, 2.0]], 60, axis=0), rng.uniform(-4, 4, size=(60, 2))])
    z = (x - x.mean(0)) / x.std(0)
    close = ((z[:, None] - z[None]) ** 2).sum(-1) <= 0.3 ** 2
    core = close.sum(1) >= 5
    label, current = -np.ones(len(x), int), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack, label[i] = [i], current
        while stack:
            for q in np.flatnonzero(close[stack.pop()] & core):
                if label[q] < 0:
                    label[q] = current
                    stack.append(q)
        current += 1
    df = frame(spark, id=list(range(len(x))), a=x[:, 0], b=x[:, 1])
    got = cluster.dbscan(df.repartition(3), ["a", "b"], ["id"], eps=0.3).toPandas().sort_values("id")["cluster"].to_numpy()
    assert len({(a, b) for a, b in zip(got[core], label[core])}) == current and set(got[core]) == set(range(current))
    for i in np.flatnonzero(~core):
        reachable = set(got[np.flatnonzero(close[i] & core)])
        assert got[i] in (reachable or {-1})


def test_kmeans_and_ward(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(50, 2)) * 0.2 + c for c in ([0, 0], [5, 5], [10, 0])])
    df = frame(spark, id=list(range(150)), a=x[:, 0], b=x[:, 1])
    centres = cluster.fit_kmeans(df, ["a", "b"])
    sizes = {r["cluster"]: r["count"] for r in cluster.cluster_profiles(cluster.assign_clusters(df, centres, ["a", "b"], ["id"]), ["a", "b"]).collect()}
    assert sizes == {0: 50, 1: 50, 2: 50}
    labelled, merges = cluster.ward(df, ["a", "b"], ["id"], micro=40)
    assert {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()} == {0: 50, 1: 50, 2: 50}
    heights = [r["height"] for r in merges.orderBy("merge").collect()]
    assert heights == sorted(heights) and len(heights) == 10


def test_segments(spark):
    df = frame(spark, v=[float(i) for i in range(1, 101)])
    for bins in (segment.quartiles(df, "v"), segment.equal_width(df, "v"), segment.equal_frequency(df, "v", 7)):
        assert sum(r["count"] for r in bins.collect()) == 100
    assert [r["count"] for r in segment.quartiles(df, "v").orderBy("bin").collect()] == [25, 25, 25, 25]
    tied = segment.quartiles(frame(spark, v=[1.0] * 9 + [2.0]), "v").collect()
    assert sum(r["count"] for r in tied) == 10
    assert segment.equal_width(frame(spark, v=[3.0, 3.0]), "v").agg(F.sum("count")).first()[0] == 2


def labelled(spark, n=400):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=n), rng.normal(size=n)
    return frame(spark, id=list(range(n)), a=a, b=b, w=[["p", "q", None][i % 3] for i in range(n)], y=3 * a + rng.normal(size=n) * 0.1,
                 c=["hi" if v > 0 else "lo" for v in a])


@pytest.mark.parametrize("method", ["gbt", "rf", "logistic"])
def test_classifiers(spark, method):
    fitted = learn.fit_classifier(labelled(spark), "c", ["a", "b", "w"], ["id"], method, trees=5, depth=3)
    row = learn.classification_metrics(fitted.predictions).first()
    assert row["accuracy"] > 0.9 and row["f1_macro"] > 0.9 and row["classes"] == 2
    if method != "logistic":
        assert learn.importances(fitted).first()["feature"] == "a"


def test_regression_and_importance(spark, tmp_path):
    df = labelled(spark)
    fitted = learn.fit_regressor(df, "y", ["a", "b", "w"], ["id"], trees=20)
    assert learn.regression_metrics(fitted.predictions).first()["r2_score"] > 0.8
    learn.save_model(fitted, str(tmp_path / "model"))
    assert len(learn.load_model(str(tmp_path / "model")).stages) == len(fitted.model.stages)
    ols = {r["term"]: r["coefficient"] for r in learn.ordinary_least_squares(df, "y", ["a", "b"]).collect()}
    assert abs(ols["a"] - 3) < 0.05 and abs(ols["b"]) < 0.05
    assert importance.correlation_importance(df, "y", ["a", "b", "c"]).orderBy("rank").first()["feature"] == "a"
    assert importance.permutation_importance(df, "y", ["a", "b"], ["id"], repeats=2, trees=5).orderBy("rank").first()["feature"] == "a"
    assert importance.shapley_importance(df, "y", ["a", "b"], ["id"], trees=5).first()["feature"] == "a"


def test_catalog(spark):
    up = spark.createDataFrame([("f.csv", "h1", 1), ("f.csv", "h2", 2), ("f.csv", "h1", 3), ("g.csv", "h2", 4), ("g.csv", "h3", 5)], "name string, fp string, at int")
    got = {r["fp"]: (r["name"], r["version"], r["previous_fingerprint"]) for r in catalog.version_chain(up, "name", "at", "fp").collect()}
    assert got == {"h1": ("f.csv", 1, None), "h2": ("f.csv", 2, "h1"), "h3": ("g.csv", 1, None)}
    df = spark.createDataFrame([(None, ""), ("", None), ("a", "bc"), ("ab", "c")], "x string, y string")
    assert df.select(catalog.row_fingerprint(df)).distinct().count() == 4
    assert catalog.table_fingerprint(df).first() == catalog.table_fingerprint(df.orderBy(F.desc("x"))).first()
    assert catalog.table_fingerprint(df).first() != catalog.table_fingerprint(df.unionByName(df)).first()


def classed(spark, n=600):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=n), rng.normal(size=n)
    c = np.where(a > 0.5, "high", np.where(np.arange(n) % 10 == 0, "rare", "low"))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "w": np.where(b > 0, "x", "y"), "c": c, "y": 3 * a + 0.1 * b}))


def test_permutation_does_not_depend_on_partitions(spark):
    df = classed(spark)
    got = [importance.permutation_importance(df.repartition(p), "y", ["a", "b"], ["id"], repeats=3, trees=10, depth=5).collect() for p in (1, 16)]
    assert got[0] == got[1] and got[0][0]["feature"] == "a" and got[0][0]["importance"] > 10 * abs(got[0][1]["importance"])


def test_stratified_folds_and_all_rows_classified(spark):
    fitted = learn.fit_classifier(classed(spark), "c", ["a", "b", "w"], ["id"], "rf", trees=10, depth=4)
    folds = {(r["target"], r["fold"]): r["count"] for r in fitted.rows.groupBy("target", "fold").count().collect()}
    for name in ("high", "low", "rare"):
        sizes = [folds.get((name, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and min(sizes) > 0
    every = learn.classify(fitted.model, fitted.rows, ["id"])
    assert every.count() == 600 and learn.predicted_driver(every).first()["rows_classified"] == 600


def test_class_attribution(spark):
    # Classes are weighted alike, so a class that is dealt at random would have its noise explained too.
    df = classed(spark).where("c <> 'rare'")
    rows = importance.class_attribution(df, "c", ["a", "b", "w"], ["id"], trees=20)
    got = {r["feature"]: r for r in rows.collect()}
    assert {r["class"] for r in got.values()} == {"low"}
    assert got["a"]["mean_abs_attribution"] > 5 * max(got["b"]["mean_abs_attribution"], got["w"]["mean_abs_attribution"])
    high = df.where("a > 1.5").first()["id"]
    one = {r["feature"]: r["attribution"] for r in importance.class_attribution(df, "c", ["a", "b", "w"], ["id"], record={"id": high}, trees=20).collect()}
    assert one["a"] < -0.2


def test_versions_across_names(spark):
    rows = [("f", 1, "h1"), ("f", 2, "h2"), ("f", 3, "h1"), ("g", 2, "h3"), ("g", 4, "h4"), ("g", 5, "h5")]
    got = {(r["name"], r["fp"]): (r["version"], r["previous_fingerprint"]) for r in
           catalog.version_chain(spark.createDataFrame(rows, "name string, at int, fp string"), "name", "at", "fp").collect()}
    assert got == {("f", "h1"): (1, None), ("f", "h2"): (2, "h1"), ("g", "h3"): (1, None), ("g", "h4"): (2, "h3"), ("g", "h5"): (3, "h4")}


def test_wide_category(spark):
    df = spark.range(2000).selectExpr("id", "concat('v', id) AS w", "cast(id % 7 AS double) AS a", "cast(id % 7 AS double) * 2 AS y")
    fitted = learn.fit_regressor(df, "y", ["w", "a"], ["id"], "gbt", trees=3, depth=3)
    assert learn.regression_metrics(fitted.predictions).first()["test_rows"] > 300


def test_quoted_line_breaks_in_csv(spark, tmp_path):
    from gridsight.sources import tables
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,NA\n')
    assert sorted(map(tuple, tables.read_text_columns(spark, str(tmp_path)).collect())) == [("1", "two\nlines"), ("2", None)]


def test_ward_merges_use_all_dimensions(spark, folder, monkeypatch):
    from gridsight.queries import models

    monkeypatch.setattr(models.cluster, "ward", lambda df, features, keep: (None, (features, df)))
    features, df = models.cluster_ward_merges(spark, folder)
    assert len(features) == len(spark.read.parquet(f"{folder}/embeddings.parquet").first()["embedding"]) and set(features) < set(df.columns)
