"""Clusters, density outliers, supervised models and feature importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F

from gridsight.functions.scale import saved, shared_folder
from gridsight.operators import anomaly, cluster, importance, learn, neighbors, timeseries as ts
from gridsight.plans.inputs import FINANCE, SALES
from gridsight.plans.kpis import DRIVER_LABELS
from gridsight.queries.registry import prepared, query, table

# Whole embedding table, three of its dimensions.
POINTS = "SELECT vec_id, label, CAST(embedding[{0}] AS DOUBLE) AS e0, CAST(embedding[{1}] AS DOUBLE) AS e1, CAST(embedding[{2}] AS DOUBLE) AS e2 FROM {{embeddings}}"
# Arrays count from 0 on Spark and from 1 in the other engine.
POINTS_SPARK, POINTS_SQL = POINTS.format(0, 1, 2), POINTS.format(1, 2, 3)
DIMS = ["e0", "e1", "e2"]
# All dimensions.
WIDE_DIMS = [f"e{i}" for i in range(64)]
WIDE_POINTS = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM {embeddings}"


def _points(spark, folder):
    return prepared(spark, folder, POINTS_SPARK)


@query("anomaly_lof", f"""WITH p AS ({POINTS_SQL}), d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1) + (a.e2 - b.e2) * (a.e2 - b.e2)) AS d
 FROM p a JOIN p b ON a.vec_id <> b.vec_id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM d) x WHERE rk <= 20),
k AS (SELECT a, max(d) AS kd FROM n GROUP BY a), l AS (SELECT n.a, 1 / (avg(greatest(k.kd, n.d)) + 1e-10) AS lrd FROM n JOIN k ON n.b = k.a GROUP BY n.a),
f AS (SELECT n.a AS vec_id, avg(o.lrd) / max(m.lrd) AS lof FROM n JOIN l o ON n.b = o.a JOIN l m ON n.a = m.a GROUP BY n.a), c AS (SELECT quantile_cont(lof, 0.95) AS cut FROM f)
SELECT vec_id, e0, e1, e2, round(lof, 4) AS anomaly_score FROM f JOIN p USING (vec_id), c WHERE lof > cut""")
def anomaly_lof(spark, folder):
    return neighbors.lof_anomalies(neighbors.local_outlier_factor(_points(spark, folder), DIMS, ["vec_id"]))


@query("cluster_dbscan", f"""WITH RECURSIVE p AS ({POINTS_SQL}), s AS (SELECT avg(e0) AS m0, stddev_pop(e0) AS s0, avg(e1) AS m1, stddev_pop(e1) AS s1, avg(e2) AS m2, stddev_pop(e2) AS s2 FROM p),
z AS (SELECT vec_id, (e0 - m0) / s0 AS z0, (e1 - m1) / s1 AS z1, (e2 - m2) / s2 AS z2 FROM p, s),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON (a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2) <= 0.25),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5), link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reached AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reached r JOIN link l ON r.b = l.a),
zk AS (SELECT vec_id, row_number() OVER (ORDER BY z0, z1, z2) AS k FROM z),
label AS (SELECT r.a AS id, min(k) AS k FROM reached r JOIN zk ON zk.vec_id = r.b GROUP BY r.a),
num AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS cluster FROM (SELECT DISTINCT k FROM label) x),
placed AS (SELECT id, k FROM label UNION ALL SELECT n.a, min(l.k) FROM near n JOIN label l ON n.b = l.id WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT p.vec_id, COALESCE(cluster, -1) AS cluster FROM p LEFT JOIN placed ON p.vec_id = placed.id LEFT JOIN num USING (k)""")
def cluster_dbscan(spark, folder):
    return cluster.dbscan(_points(spark, folder), DIMS, ["vec_id"], eps=0.5, min_samples=5).select("vec_id", "cluster")


CENTRES = [(0, 10.0, 20000.0, 0.02), (1, 25.0, 50000.0, 0.05), (2, 40.0, 80000.0, 0.08)]
SCALES = [(25.0, 14.0), (50000.0, 27000.0), (0.05, 0.03)]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("cluster_assign", "WITH d AS (SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"pow((l_quantity - {a}) / {SCALES[0][1]}, 2) + pow((l_extendedprice - {b}) / {SCALES[1][1]}, 2) + pow((l_discount - {c}) / {SCALES[2][1]}, 2) AS d{i}" for i, a, b, c in CENTRES) + """ FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d""")
def cluster_assign(spark, folder):
    rows = [(i, a, b, c, *[x for s in SCALES for x in s]) for i, a, b, c in CENTRES]
    schema = "cluster int, l_quantity double, l_extendedprice double, l_discount double, " + ", ".join(f"mean_{i} double, deviation_{i} double" for i in range(3))
    centres = spark.createDataFrame(rows, schema)
    return cluster.assign_clusters(table(spark, folder, "lineitem"), centres, LINE_FEATURES, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "cluster")


@query("cluster_kmeans")
def cluster_kmeans(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_FEATURES)
    centres = cluster.fit_kmeans(lines, LINE_FEATURES)
    return cluster.cluster_profiles(cluster.assign_clusters(lines, centres, LINE_FEATURES), LINE_FEATURES)


@query("cluster_ward")
def cluster_ward(spark, folder):
    assigned, _ = cluster.ward(table(spark, folder, "lineitem").select(*LINE_FEATURES), LINE_FEATURES)
    return cluster.cluster_profiles(assigned, LINE_FEATURES)


@query("cluster_ward_merges")
def cluster_ward_merges(spark, folder):
    return cluster.ward(prepared(spark, folder, WIDE_POINTS), WIDE_DIMS, ["vec_id"])[1]


@query("anomaly_iforest_score")
def anomaly_iforest_score(spark, folder):
    # Fit on order lines, save and load the forest as tables, then score the lines.
    lines = table(spark, folder, "lineitem").withColumn("line_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    nodes, scaling = anomaly.fit_forest(lines, LINE_FEATURES, "line_key")
    return anomaly.score_forest(lines, saved(nodes), scaling, ["l_orderkey", "l_linenumber"])


# --- Supervised --------------------------------------------------------------------

LABELLED = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, o_totalprice, o_orderpriority, o_orderstatus,
 CASE WHEN l_extendedprice > 60000 AND l_discount > 0.04 THEN 'premium_rate' WHEN l_quantity > 30 THEN 'exposure' WHEN l_tax > 0.06 AND l_orderkey % 3 = 0 THEN 'fx' ELSE 'mix' END AS driver
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]
WORDS = ["l_returnflag", "o_orderpriority"]
KEY = ["l_orderkey", "l_linenumber"]


def _labelled(spark, folder):
    return prepared(spark, folder, LABELLED)


CLASSIFIERS = ["gbt", "rf", "logistic"]
REGRESSION = {"reg_gbt": ("o_totalprice", ["l_quantity", "l_extendedprice", "l_discount", *WORDS], "gbt"),
              "reg_rf": ("l_extendedprice", ["l_quantity", "l_discount", "o_totalprice", *WORDS], "rf")}


def _stored(spark, folder, name) -> tuple[learn.Fitted, str]:
    """A model with the operator's defaults, saved with its predictions, as several queries report on it; and where it is."""
    rows = _labelled(spark, folder)
    if name in REGRESSION:
        target, features, method = REGRESSION[name]
        return learn.stored(rows, {"target": target, "features": features, "method": method}, lambda: learn.fit_regressor(rows, target, features, KEY, method))
    return learn.stored(rows, {"target": "driver", "features": NUMBERS + WORDS, "method": name},
                        lambda: learn.fit_classifier(rows, "driver", NUMBERS + WORDS, KEY, name))


def _fitted(spark, folder, name) -> learn.Fitted:
    return _stored(spark, folder, name)[0]


@query("clf_gbt")
def clf_gbt(spark, folder):
    return learn.classification_metrics(_fitted(spark, folder, "gbt").predictions)


@query("clf_rf")
def clf_rf(spark, folder):
    return learn.classification_metrics(_fitted(spark, folder, "rf").predictions)


@query("clf_logistic")
def clf_logistic(spark, folder):
    return learn.classification_metrics(_fitted(spark, folder, "logistic").predictions)


@query("clf_majority", """SELECT CAST(quality AS VARCHAR) || '-' || CAST(toxic AS VARCHAR) AS class, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS share,
 row_number() OVER (ORDER BY count(*) DESC, quality, toxic) = 1 AS predicted FROM labels GROUP BY quality, toxic""")
def clf_majority(spark, folder):
    return learn.majority_class(table(spark, folder, "labels").withColumn("class", F.concat_ws("-", "quality", "toxic")), "class")


@query("confusion_matrix")
def confusion_matrix(spark, folder):
    return learn.confusion(_fitted(spark, folder, "rf").predictions)


@query("class_report")
def class_report(spark, folder):
    return learn.class_metrics(_fitted(spark, folder, "rf").predictions)


@query("cross_validation")
def cross_validation(spark, folder):
    return learn.cross_validate(_labelled(spark, folder), "driver", NUMBERS, KEY, "logistic")


@query("predicted_driver")
def predicted_driver(spark, folder):
    # The saved model is loaded and classifies every row.
    fitted, path = _stored(spark, folder, "gbt")
    return learn.predicted_driver(learn.classify(learn.load_model(f"{path}/model", spark), fitted.rows, KEY))


@query("reg_gbt")
def reg_gbt(spark, folder):
    return learn.regression_metrics(_fitted(spark, folder, "reg_gbt").predictions)


@query("reg_rf")
def reg_rf(spark, folder):
    return learn.regression_metrics(_fitted(spark, folder, "reg_rf").predictions)


@query("key_drivers")
def key_drivers(spark, folder):
    return learn.importances(_fitted(spark, folder, "reg_rf"))


@query("training_summary")
def training_summary(spark, folder):
    """The training job: every model with the metrics of its held-out fold in one table.

    The fits are independent and run side by side, so that the short jobs of one fill the cores that another leaves idle.
    """
    names = [*CLASSIFIERS, "reg_gbt", "reg_rf"]
    shared_folder(spark)  # named before the fits look for it side by side, so that all are stored in one folder
    with ThreadPoolExecutor(len(names)) as pool:
        fits = list(pool.map(lambda name: _fitted(spark, folder, name), names))
    parts = []
    for name, fitted in zip(names, fits):
        metrics = (learn.regression_metrics if name in REGRESSION else learn.classification_metrics)(fitted.predictions)
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns])
        parts.append(metrics.select(F.lit(name).alias("model"), F.explode(pairs).alias("m")).select("model", "m.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("reg_ols", """WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem
 WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)
SELECT 'intercept' AS term, round(a, 4) AS coefficient, round(r2, 4) AS r2_score, n AS rows_used FROM r UNION ALL SELECT 'l_quantity', round(b, 4), round(r2, 4), n FROM r""")
def reg_ols(spark, folder):
    return learn.ordinary_least_squares(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"])


def _lagged(spark, folder):
    series = ts.build_series(prepared(spark, folder, SALES), "o_orderdate", "o_totalprice", ["n_name"], "month")
    return series, learn.stored(series, {"forecast": "lagged"}, lambda: learn.lagged_forecast(series, ["n_name"]))[0]


@query("fc_gbt")
def fc_gbt(spark, folder):
    return learn.regression_metrics(_lagged(spark, folder)[1].predictions)


@query("fc_gbt_ahead")
def fc_gbt_ahead(spark, folder):
    series, fitted = _lagged(spark, folder)
    return learn.recursive_forecast(fitted, series, ["n_name"])


IMPORTANT = ["exposure_growth_variance", "premium_rate_variance", "claim_severity_variance", "cost_actual"]


@query("imp_correlation", f"WITH f AS ({FINANCE}), c AS (" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS feature, round(abs(corr({c}, revenue_actual)), 4) AS importance, count(*) AS rows_used FROM f" for i, c in enumerate(IMPORTANT)) +
    ") SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, place) AS rank, rows_used FROM c")
def imp_correlation(spark, folder):
    return importance.correlation_importance(prepared(spark, folder, FINANCE), "revenue_actual", [*IMPORTANT, "region"])


@query("imp_permutation")
def imp_permutation(spark, folder):
    return importance.permutation_importance(_labelled(spark, folder), "l_extendedprice", ["l_quantity", "l_discount", "o_totalprice", "l_returnflag"], KEY)


@query("imp_shapley")
def imp_shapley(spark, folder):
    # Of the regressor that reg_gbt reports.
    return importance.fitted_importance(_fitted(spark, folder, "reg_gbt"))


@query("class_attribution")
def class_attribution(spark, folder):
    # Of the classifier that clf_gbt reports.
    return importance.fitted_attribution(_fitted(spark, folder, "gbt"))


assert set(IMPORTANT[:3]) <= set(DRIVER_LABELS)
