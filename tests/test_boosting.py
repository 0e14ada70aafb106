from concurrent.futures import ThreadPoolExecutor
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsight.functions import scale
from gridsight.operators import boosting, encoding, importance, learn


def classed(spark, n=900, parts=4):
    rng = np.random.default_rng(3)
    a, b, c, d = rng.normal(size=(4, n))
    kind = np.where(a > 0.6, "high", np.where(b > 0.2, "mid", "low"))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "d": d, "k": kind, "y": 3 * a - b + 0.1 * c,
                                               "w": [f"v{i % 7}" for i in range(n)]})).repartition(parts)


def plain_softmax_trees(bins, y, train, weights, rounds, depth, rate, columns):
    """The same boosting as a loop over rows and nodes."""
    n, classes = len(bins), weights.shape[0]
    scores = np.zeros((n, classes))
    scale_of = boosting.UNIT / weights.max()
    for number in range(rounds):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = scores.copy()
        for k in range(classes):
            g = np.rint(weights[y] * (p[:, k] - (y == k)) * scale_of)
            h = np.rint(weights[y] * 2 * p[:, k] * (1 - p[:, k]) * scale_of)

            def grow(rows, level):
                gs, hs = g[rows & train].sum() / scale_of, h[rows & train].sum() / scale_of
                best = (1e-9, None)
                if level < depth:
                    for c in range(columns):
                        for cut in range(64):
                            left = rows & (bins[:, c] <= cut)
                            lg, lh = g[left & train].sum() / scale_of, h[left & train].sum() / scale_of
                            rg, rh = gs - lg, hs - lh
                            if lh < 1 or rh < 1:
                                continue
                            gain = lg * lg / (lh + 1) + rg * rg / (rh + 1) - gs * gs / (hs + 1)
                            if gain > best[0]:
                                best = (gain, (c, cut))
                if best[1] is None:
                    new[rows, k] += -rate * gs / (hs + 1)
                    return
                c, cut = best[1]
                grow(rows & (bins[:, c] <= cut), level + 1)
                grow(rows & (bins[:, c] > cut), level + 1)
            grow(np.ones(n, bool), 0)
        scores = new
    return scores


def test_softmax_trees_equal_a_plain_loop(spark):
    df = classed(spark, 300)
    prepared = learn.prepared_classes(df, "k", ["a", "b"], ["id"], "gbt")
    fit = learn.boosted(prepared, ["id"], True, 10, 3, [0], 1.0, 0.3)[0]
    rows = prepared.rows.orderBy("id").toPandas()
    trees = fit.model.trees
    bins = boosting.bins_of(trees.edges, rows[["n_a", "n_b"]].to_numpy())
    y = np.searchsorted(trees.classes, rows["target"])
    train = (rows["fold"] != 0).to_numpy()
    counts = np.bincount(y[train])
    want = plain_softmax_trees(bins, y, train, train.sum() / (len(counts) * counts), 10, 3, 0.3, 2)
    assert trees.classes == ["high", "low", "mid"] and np.allclose(boosting.margins(trees, bins), want, atol=1e-6)
    found = {r["id"]: r["predicted"] for r in fit.predictions.collect()}
    held = rows[~train]
    assert found == dict(zip(held["id"], np.array(trees.classes)[want[~train].argmax(axis=1)]))


def test_folds_side_by_side_equal_single_fits_on_any_partitioning(spark):
    prepared = learn.prepared_classes(classed(spark), "k", ["a", "b", "w"], ["id"], "gbt")
    both = learn.boosted(prepared, ["id"], True, 4, 3, [1, 3], 0.8)
    other = learn.prepared_classes(classed(spark, parts=13), "k", ["a", "b", "w"], ["id"], "gbt")
    for fit, fold in zip(both, (1, 3)):
        one = learn.boosted(other, ["id"], True, 4, 3, [fold], 0.8)[0]
        assert np.array_equal(fit.model.trees.value, one.model.trees.value) and np.array_equal(fit.model.trees.cut, one.model.trees.cut)
        assert {r["fold"] for r in fit.predictions.join(prepared.rows.select("id", "fold"), "id").collect()} == {fold}


def test_many_rounds_keep_their_scores(spark):
    # More rounds than rows carry between two saved tables.
    fit = learn.fit_regressor(classed(spark), "y", ["a", "b", "c"], ["id"], trees=40, depth=4)
    assert learn.regression_metrics(fit.predictions).first()["r2_score"] > 0.75
    top = learn.importances(fit).collect()
    assert top[0]["feature"] == "a" and abs(sum(r["importance"] for r in top) - 1) < 1e-5


@pytest.mark.parametrize("levels", [10_000, 3])
def test_ordered_statistics_equal_a_plain_loop(spark, levels):
    n = 30_000
    rng = np.random.default_rng(8)
    # A third of the rows have one level, which goes on over several parts.
    word = np.where(np.arange(n) % 3 == 0, "hot", [f"v{v}" for v in rng.integers(0, levels, n)])
    pdf = pd.DataFrame({"id": np.arange(n), "w": word, "t": rng.normal(size=n), "fold": np.arange(n) % 5})
    rows = spark.createDataFrame(pdf).repartition(7)
    got = encoding.encode(rows, "w", ["id"], ["t"], [0, 2], "e")
    found = got.rows.select("id", "e_0_0", "e_1_0").toPandas().set_index("id").sort_index()
    order = rows.select("id", F.xxhash64(F.lit("order"), F.col("id")).alias("h")).toPandas().set_index("id")["h"]
    for m, fold in enumerate((0, 2)):
        train = pdf["fold"] != fold
        prior = pdf["t"][train].mean()
        whole = pdf[train].groupby("w")["t"].agg(["sum", "count"])
        sums, counts, want = {}, {}, np.zeros(n)
        for i in order.sort_values().index:
            level = pdf["w"].iat[i]
            if train.iat[i]:
                want[i] = (sums.get(level, 0.0) + prior) / (counts.get(level, 0) + 1)
                sums[level], counts[level] = sums.get(level, 0.0) + pdf["t"].iat[i], counts.get(level, 0) + 1
            else:
                s, c = whole.loc[level] if level in whole.index else (0.0, 0)
                want[i] = (s + prior) / (c + 1)
        assert np.allclose(found[f"e_{m}_0"], want)
    new = spark.createDataFrame([(1, "hot"), (2, "never")], "id int, w string")
    coded = {r["w"]: r["x"] for r in encoding.code_new(new, "w", got.levels, got.priors[0], ["x"]).collect()}
    hot = pdf[(pdf["w"] == "hot") & (pdf["fold"] != 0)]["t"]
    assert np.isclose(coded["hot"], (hot.sum() + got.priors[0][0]) / (len(hot) + 1)) and np.isclose(coded["never"], got.priors[0][0])


def enumerated(trees, bins, output, width):
    """Shapley values by all orders of the columns, each set's worth by walking the trees with unknown columns averaged by cover."""
    def worth(tree, row, known, node=0):
        feature, cut, value, cover = (a[tree, output] for a in (trees.feature, trees.cut, trees.value, trees.cover))
        if feature[node] < 0:
            return value[node]
        if feature[node] in known:
            return worth(tree, row, known, 2 * node + 1 + int(row[feature[node]] > cut[node]))
        return sum(cover[c] / cover[node] * worth(tree, row, known, c) for c in (2 * node + 1, 2 * node + 2))

    sets = [s for size in range(width + 1) for s in combinations(range(width), size)]
    out = np.zeros((len(bins), width))
    for at, row in enumerate(bins):
        value = {s: sum(worth(t, row, s) for t in range(len(trees.feature))) for s in sets}
        for order in permutations(range(width)):
            for place, column in enumerate(order):
                out[at, column] += value[tuple(sorted(order[:place + 1]))] - value[tuple(sorted(order[:place]))]
    return out / factorial(width)


def test_attributions_equal_enumeration_and_add_up(spark):
    df = classed(spark, 400)
    fit = learn.fit_classifier(df, "k", ["a", "b", "c", "d"], ["id"], trees=6, depth=4)
    per_row = importance.row_attributions(fit, 2).orderBy("id").collect()
    assert len(per_row) == 400
    for row in per_row:
        assert abs(row["base"] + sum(row["attribution"].values()) - row["margin"]) < 1e-9
    rows = fit.rows.orderBy("id").limit(12).toPandas()
    bins = boosting.bins_of(fit.model.trees.edges, rows[["n_a", "n_b", "n_c", "n_d"]].to_numpy())
    want = enumerated(fit.model.trees, bins, 2, 4)
    assert np.allclose([[r["attribution"][c] for c in "abcd"] for r in per_row[:12]], want, atol=1e-9)


def test_attributions_of_coded_categories_add_up(spark):
    fit = learn.fit_regressor(classed(spark), "y", ["a", "w"], ["id"], trees=5)
    for row in importance.row_attributions(fit).limit(50).collect():
        assert set(row["attribution"]) == {"a", "w"} and abs(row["base"] + sum(row["attribution"].values()) - row["margin"]) < 1e-9


def test_fits_are_stored_and_go_with_drop_saved(spark):
    df = classed(spark)
    calls = []

    def fit(method):
        calls.append(method)
        return learn.fit_classifier(df, "k", ["a", "b", "w"], ["id"], method, trees=3, depth=3)

    for method in ("gbt", "logistic"):
        first, path = learn.stored(df, {"m": method}, lambda: fit(method))
        again, other = learn.stored(df.orderBy("a"), {"m": method}, lambda: fit(method))
        assert path == other and sorted(map(tuple, first.predictions.collect())) == sorted(map(tuple, again.predictions.collect()))
        assert learn.classify(again.model, again.rows, ["id"]).count() == 900
    assert calls == ["gbt", "logistic"]
    assert learn.stored(df.limit(800), {"m": "gbt"}, lambda: fit("gbt"))[1] != path
    scale.drop_saved(spark)
    assert not scale.exists(spark, path)
    refit = learn.stored(df, {"m": "logistic"}, lambda: fit("logistic"))[0]
    assert learn.classification_metrics(refit.predictions).first()["test_rows"] == 180


def test_stored_fits_are_read_in_new_threads(spark):
    df = classed(spark, 400)
    stored = lambda method: learn.stored(df, {"threads": method}, lambda: learn.fit_classifier(
        df, "k", ["a", "b", "w"], ["id"], method, trees=3, depth=3))[0]
    methods = ("gbt", "rf", "logistic")
    before = [learn.classification_metrics(stored(m).predictions).first() for m in methods]
    with ThreadPoolExecutor(3) as pool:
        again = list(pool.map(stored, methods))
    assert [learn.classification_metrics(f.predictions).first() for f in again] == before
    assert all(learn.classify(f.model, f.rows, ["id"]).count() == 400 for f in again)


def test_many_classes_and_rare_ones(spark):
    df = spark.range(1200).selectExpr("id", "cast(id % 30 as double) AS x", "concat('c', id % 30) AS k").unionByName(
        spark.createDataFrame([(5000 + i, 77.0, "rare") for i in range(5)] + [(6000, 1.0, None)], "id bigint, x double, k string"))
    fit = learn.fit_classifier(df, "k", ["x"], ["id"], trees=5, depth=5)
    assert len(fit.model.trees.classes) == 31 and "OTHER" in fit.model.trees.classes
    assert learn.classification_metrics(fit.predictions).first()["accuracy"] > 0.95


def test_recursive_forecast_equals_a_plain_loop(spark):
    months = pd.date_range("2019-01-01", periods=40, freq="MS")
    rows = [(k, d.date(), base + 5 * (d.month % 6) + 0.3 * i) for k, base in (("p", 10.0), ("q", 200.0)) for i, d in enumerate(months)]
    rows += [("r", months[0].date(), 1.0)]
    series = spark.createDataFrame(rows, "k string, ds date, y double")
    fit = learn.lagged_forecast(series, ["k"], trees=30)
    got = learn.recursive_forecast(fit, series, ["k"], periods=4).orderBy("k", "h").collect()
    assert [(r["k"], r["h"]) for r in got] == [(k, h) for k in "pq" for h in range(1, 5)]
    trees = fit.model.trees
    codes = {r["w_k"]: r["x"] for r in encoding.code_new(spark.createDataFrame([("p",), ("q",)], "w_k string"), "w_k",
                                                         fit.model.coders[0][1], fit.model.coders[0][2], ["x"]).collect()}
    for k in "pq":
        lags = [y for key, _, y in rows if key == k][-1:-4:-1]
        for r in [r for r in got if r["k"] == k]:
            values = {"n_lag_1": lags[0], "n_lag_2": lags[1], "n_lag_3": lags[2], "n_month_of_year": float(r["ds"].month), fit.model.coders[0][3][0]: codes[k]}
            y = boosting.margins(trees, boosting.bins_of(trees.edges, np.array([[values[c] for c in trees.columns]])))[0, 0]
            assert r["yhat"] == round(y, 2) and r["yhat_lower"] < r["yhat"] < r["yhat_upper"]
            lags = [y, *lags[:2]]


def test_slots_and_their_ends_equal_a_plain_walk():
    rng = np.random.default_rng(5)
    columns, depth = rng.integers(0, 64, (3, 500)).astype(np.uint8), 4
    feature = np.where(rng.random(31) < 0.75, rng.integers(0, 3, 31), -1).astype(np.int16)
    feature[0], feature[15:] = 1, -1
    for i in range(1, 15):
        feature[i] = feature[i] if feature[(i - 1) // 2] >= 0 else -1
    cut = rng.integers(0, 64, 31).astype(np.uint8)
    ends = boosting._ends(feature, depth)[boosting.slots(columns, feature, cut, depth)]
    for row, end in enumerate(ends):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + 1 + int(columns[feature[node], row] > cut[node])
        assert node == end


def test_packed_rows_travel_in_blocks(spark):
    rows = spark.range(2500).selectExpr("id", "cast(id % 5 as int) AS fold", "cast(id as double) AS target", "cast(id % 9 as double) AS x")
    edges = [np.arange(8.0)]
    table = boosting.packed(rows.repartition(2), ["x"], edges, F.col("id"), np.zeros((1, 1)))
    assert table.count() <= 8 and table.agg(F.sum("rows")).first()[0] == 2500
    read = list(boosting._read(iter(table.toArrow().to_batches()), 1, 1, np.inf))
    assert len(read) == 1 and (read[0].columns[0] == read[0].y % 9).all() and (read[0].fold == read[0].y % 5).all()


def test_wrong_guesses_change_nothing(spark, monkeypatch):
    prepared = learn.prepared_classes(classed(spark), "k", ["a", "b"], ["id"], "gbt")
    found = []
    for rows in (boosting.GUESS_ROWS, 60):
        monkeypatch.setattr(boosting, "GUESS_ROWS", rows)
        found.append(learn.boosted(prepared, ["id"], True, 4, 4, [0], 0.8)[0].model.trees)
    assert all(np.array_equal(getattr(found[0], n), getattr(found[1], n)) for n in ("feature", "cut", "value", "cover", "gain"))
