"""Supervised models: preparation, fits, metrics, importances, training.

Forests, logistic and linear models are Spark ML's; boosted trees are those of ``boosting``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridsight.functions.parsing import as_text, kinds, missing, number
from gridsight.functions.quantiles import medians
from gridsight.functions.scale import exists, kept_at, row_digest, row_numbers, saved, shared_folder, spread, with_totals
from gridsight.operators import boosting, encoding

MIN_CLASS_SIZE = 20
TEST_SHARE = 5  # one row in five
RATE, DEPTH, ROW_SHARE = 0.05, 5, 0.8


@dataclass
class Prepared:
    """Rows ready for a fit: ``keep…, label_text or target, features, fold``."""
    rows: DataFrame
    columns: list[str]
    stages: list[Any]
    words: list[str]


def fold_of(key: list[str], folds: int = TEST_SHARE, seed: int = 42) -> Column:
    """A row's fold from the hash of its key: the same in every run and on every cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]), F.lit(folds)).cast("int")


def prepare(df: DataFrame, features: list[str], key: list[str], target: Column, one_hot: bool = False, fill: str = "median",
            stratified: bool = False, drop_empty: bool = False) -> Prepared:
    """Numbers filled with the column's median (or 0), text as an indexed category.

    ``stratified`` deals each class evenly over the folds, in the order of a hash of the key;
    ``drop_empty`` leaves out rows without any feature value.

    Category levels are learnt inside the pipeline; unseen ones get a level of their own.
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    kind = kinds(df)
    features = [c for c in features if c in df.columns]
    numeric = [c for c in features if kind[c] in ("number", "boolean")]
    words = [c for c in features if c not in numeric]
    rows = df.select(
        *[F.col(f"`{k}`") for k in key], target.alias("target"),
        *[number(df, c).alias(f"n_{c}") for c in numeric],
        *[F.coalesce(F.when(~missing(df, c), as_text(df, c)), F.lit("Unknown")).alias(f"w_{c}") for c in words],
        fold_of(key).alias("fold"),
    ).where(F.col("target").isNotNull())
    if drop_empty:
        some = [F.col(f"n_{c}").isNotNull() for c in numeric] + [F.col(f"w_{c}") != "Unknown" for c in words]
        rows = rows.where(reduce(or_, some))
    if stratified:
        order = [F.col("target"), F.xxhash64(F.lit(42), *[F.col(f"`{k}`") for k in key]), *[F.col(f"`{k}`") for k in key]]
        rows = row_numbers(rows, order, "_rank").withColumn("fold", (F.col("_rank") % TEST_SHARE).cast("int")).drop("_rank")
    rows = saved(spread(rows))
    if numeric:
        holes = rows.agg(*[F.count_if(F.col(f"n_{c}").isNull()).alias(f"h_{i}") for i, c in enumerate(numeric)]).first()
        gaps = [f"n_{c}" for i, c in enumerate(numeric) if holes[f"h_{i}"]]
        if gaps:
            values = {c: 0.0 for c in gaps} if fill == "zero" else medians(rows, gaps)
            rows = rows.fillna({c: (0.0 if v is None else v) for c, v in values.items()})
    stages: list[Any] = [StringIndexer(inputCol=f"w_{c}", outputCol=f"i_{c}", handleInvalid="keep") for c in words]
    inputs = [f"n_{c}" for c in numeric] + [f"i_{c}" for c in words]
    if one_hot and words:
        stages.append(OneHotEncoder(inputCols=[f"i_{c}" for c in words], outputCols=[f"o_{c}" for c in words], dropLast=False))
        inputs = [f"n_{c}" for c in numeric] + [f"o_{c}" for c in words]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Prepared(rows, numeric + words, stages, words)


def with_classes(df: DataFrame, target: str, smallest: int = MIN_CLASS_SIZE) -> DataFrame:
    """Rows that have a target, with ``_class``: the target as text, classes of fewer than ``smallest`` rows merged into OTHER."""
    text = df.where(~missing(df, target)).withColumn("_text", as_text(df, target))
    sizes = saved(text.groupBy("_text").agg(F.count("*").alias("_rows")))
    return with_totals(text, sizes, ["_text"], "_rows").withColumn("_class", F.when(F.col("_rows") >= smallest, F.col("_text")).otherwise("OTHER")).drop(
        "_text", "_rows")


def _class_weights(rows: DataFrame) -> Column:
    """Balanced weights: rows / (classes x rows of the class)."""
    sizes = {r["target"]: r["count"] for r in rows.groupBy("target").count().collect()}
    total = sum(sizes.values())
    return F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, total / (len(sizes) * n))])[F.col("target")]


class BoostedModel:
    """Boosted trees with the level tables that code the categories of new rows."""

    def __init__(self, trees: boosting.Trees, coders: list[tuple[str, DataFrame, list[float], list[str]]], numeric: list[str]):
        self.trees, self.coders, self.numeric = trees, coders, numeric

    @property
    def stages(self) -> list[Any]:
        return [*self.coders, self.trees]

    def feature_of(self) -> list[str]:
        """The feature behind each column of the trees."""
        coded = {name: word[2:] for word, _, _, names in self.coders for name in names}
        return [coded.get(c, c[2:]) for c in self.trees.columns]

    def coded(self, rows: DataFrame) -> DataFrame:
        """Prepared rows with the columns of the trees; every row is coded as a new one."""
        for word, levels, priors, names in self.coders:
            rows = encoding.code_new(rows, word, levels, priors, names)
        return rows

    def transform(self, rows: DataFrame) -> DataFrame:
        return boosting.predict(self.coded(rows), self.trees, rows.columns)

    def save(self, spark: SparkSession, path: str) -> None:
        boosting.save(spark, self.trees, f"{path}/trees")
        for i, (_, levels, _, _) in enumerate(self.coders):
            levels.write.mode("overwrite").parquet(f"{path}/levels{i}")
        facts = json.dumps([self.numeric, [[w, p, n] for w, _, p, n in self.coders]])
        spark.createDataFrame([(facts,)], "facts string").write.mode("overwrite").parquet(f"{path}/boosted")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        numeric, coders = json.loads(spark.read.parquet(f"{path}/boosted").first()["facts"])
        tables = [(w, spark.read.parquet(f"{path}/levels{i}"), p, n) for i, (w, p, n) in enumerate(coders)]
        return BoostedModel(boosting.load(spark, f"{path}/trees"), tables, numeric)


@dataclass
class Fitted:
    model: PipelineModel | BoostedModel
    predictions: DataFrame
    columns: list[str]
    metrics: dict[str, float]
    rows: DataFrame | None = None


def boosted(prepared: Prepared, key: list[str], named: bool, trees: int, depth: int, held: list[int], share: float, rate: float = RATE) -> list[Fitted]:
    """Boosted trees for each held-out fold, grown side by side, with the predictions of that fold.

    ``named``: the target is a class; all classes share one softmax and one aggregate a level. Categories become ordered
    target statistics of every class (of one, where there are two), or of the number.
    """
    rows = prepared.rows
    spark = rows.sparkSession
    sizes = rows.groupBy("fold", *(["target"] if named else [])).agg(
        F.count("*").alias("n"), *([] if named else [F.sum("target").alias("sum"), F.min("target").alias("low"), F.max("target").alias("high")])).collect()
    weights = None
    if named:
        classes = sorted({r["target"] for r in sizes if any(r["fold"] != f for f in held)})
        counts = np.array([[sum(r["n"] for r in sizes if r["fold"] != f and r["target"] == c) for c in classes] for f in held], float)
        weights = counts.sum(axis=1, keepdims=True) / (len(classes) * np.maximum(counts, 1))
        base, scale = np.zeros((len(held), len(classes))), boosting.UNIT / weights.max()
        numbers = spark.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], "target string, _number double")
        rows = rows.join(F.broadcast(numbers), "target")
        shown = range(1, 2) if len(classes) == 2 else range(len(classes))
        targets = {f"_t{i}": (F.col("_number") == i).cast("double") for i in shown}
    else:
        classes = []
        sums = [[sum(r[c] for r in sizes if r["fold"] != f) for c in ("sum", "n")] for f in held]
        base = np.array([[s / max(1, n)] for s, n in sums])
        reach = max((abs(r[c] - b) for r in sizes for c in ("low", "high") for b in base[:, 0]), default=1.0)
        scale = boosting.UNIT / max(reach, 1e-300)
        rows, targets = rows.withColumn("_number", F.col("target").cast("double")), {"_t0": F.col("_number")}
    numeric = [f"n_{c}" for c in prepared.columns if c not in prepared.words]
    columns, layout, coders = list(numeric), [list(range(len(numeric))) for _ in held], []
    rows = rows.withColumns(targets)
    for word in prepared.words:
        coded = encoding.encode(rows, f"w_{word}", key, list(targets), held, f"e_{word}")
        rows = coded.rows
        for m, names in enumerate(coded.codes):
            layout[m] += range(len(columns), len(columns) + len(names))
            columns += names
        coders.append((f"w_{word}", coded.levels, coded.priors[0], coded.codes[0]))
    order = F.struct(*[F.col(f"`{k}`") for k in key])
    edges = boosting.cut_points(rows, columns, order)
    parts = max(spark.sparkContext.defaultParallelism, sum(r["n"] for r in sizes) // boosting.PART_ROWS)
    # A single model never sees the fold that it holds out.
    grown = rows if len(held) > 1 else rows.filter(F.col("fold") != held[0])
    table = saved(boosting.packed(grown.withColumn("target", F.col("_number")).repartition(parts), columns, edges, order, base))
    ensembles = boosting.boost(table, columns, edges, layout, held, classes, base, weights, scale, trees, rate, depth, share)
    out = []
    for fold, ensemble in zip(held, ensembles):
        found = boosting.predict(rows.filter(F.col("fold") == fold), ensemble, [*key, "target"])
        out.append(Fitted(BoostedModel(ensemble, coders, numeric), saved(found.select(*key, F.col("target").alias("actual"), "predicted")), prepared.columns, {},
                          prepared.rows))
    return out


def fit_classifier(df: DataFrame, target: str, features: list[str], key: list[str], method: str = "gbt", trees: int = 200,
                   depth: int | None = None, holdout: int = 0, prepared: Prepared | None = None) -> Fitted:
    """Fit on four folds and predict the fifth.

    ``gbt``: boosted trees, one softmax over all classes, balanced weights.
    ``rf``: random forest with one-hot categories. ``logistic``: standardised numbers.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer

    prepared = prepared or prepared_classes(df, target, features, key, method)
    rows = prepared.rows
    _enough(rows, {"gbt": 20, "rf": 30, "logistic": 20}[method], method)
    if method == "gbt":
        return boosted(prepared, key, True, trees, depth or DEPTH, [holdout], ROW_SHARE)[0]
    train, test = rows.where(F.col("fold") != holdout), rows.where(F.col("fold") == holdout)
    labels = StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    stages = list(prepared.stages)
    if method == "rf":
        learner = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth or 10, seed=42)
    else:
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True))
        learner = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=100, family="auto")
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)
    model = Pipeline(stages=[labels, *stages, learner, back]).fit(train)
    scored = model.transform(test).select(*key, F.col("target").alias("actual"), "predicted")
    return Fitted(model, scored, prepared.columns, {}, rows)


def prepared_classes(df: DataFrame, target: str, features: list[str], key: list[str], method: str) -> Prepared:
    """Rows for a classifier: classes dealt evenly over the folds, and what each method does with missing values."""
    if method == "logistic":
        features = [c for c in features if kinds(df)[c] in ("number", "boolean")]
    return prepare(with_classes(df, target), features, key, F.col("_class"), one_hot=method == "rf", fill="zero" if method == "gbt" else "median",
                   stratified=True, drop_empty=method == "gbt")


def _enough(rows: DataFrame, least: int, method: str) -> None:
    if rows.limit(least).count() < least:
        raise ValueError(f"{method} needs at least {least} labelled rows")


def classify(model: PipelineModel | BoostedModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Prepared rows, all of them, with their ``actual`` and ``predicted`` class by a fitted or loaded model."""
    return model.transform(rows).select(*keep, F.col("target").alias("actual"), "predicted")


def confusion(predictions: DataFrame) -> DataFrame:
    """``actual, predicted, count``: at most classes squared rows."""
    return predictions.groupBy("actual", "predicted").agg(F.count("*").alias("count"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, F1; classes only predicted count too."""
    cells = confusion(predictions)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(zero)
    side = lambda name, support, predicted, hits: F.struct(
        F.col(name).alias("class"), support.alias("support"), predicted.alias("predicted"), hits.alias("hit"))
    sides = cells.select(F.explode(F.array(
        side("actual", F.col("count"), zero, hit), side("predicted", zero, F.col("count"), zero))).alias("s")).select("s.*")
    totals = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return totals.select(
        "class", "support", ratio(F.col("hit"), F.col("predicted")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"), "hit")


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1, classes, rows."""
    return class_metrics(predictions).agg(
        F.round(F.sum("hit") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("f1_macro"),
        F.count("*").alias("classes"), F.sum("support").alias("test_rows"))


def majority_class(df: DataFrame, target: str) -> DataFrame:
    """Class sizes and shares; the largest class is the baseline's prediction."""
    sizes = df.where(~missing(df, target)).groupBy(as_text(df, target).alias("class")).agg(F.count("*").alias("count"))
    whole = sizes.agg(F.struct(F.sum("count").alias("n"), F.min(F.struct((-F.col("count")).alias("c"), F.col("class").alias("k"))).alias("top")).alias("w")).scalar()
    return sizes.select("class", "count", whole.alias("_w")).select(
        "class", "count", F.round(F.col("count") / F.col("_w.n"), 4).alias("share"), (F.col("class") == F.col("_w.top.k")).alias("predicted"))


def predicted_driver(predictions: DataFrame) -> DataFrame:
    """The class predicted most often, its share and the rows classified."""
    counts = predictions.groupBy("predicted").agg(F.count("*").alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("predicted").alias("p"))).alias("b"), F.sum("n").alias("rows_classified")).select(
        F.col("b.p").alias("predicted_driver"), F.round(-F.col("b.n") / F.col("rows_classified"), 4).alias("confidence"), "rows_classified")


def fit_regressor(df: DataFrame, target: str, features: list[str], key: list[str], method: str = "gbt", trees: int = 200,
                  depth: int | None = None, holdout: int = 0) -> Fitted:
    """Boosted trees (categories as target statistics) or a random forest (one-hot) on four of five folds."""
    from pyspark.ml.regression import RandomForestRegressor

    prepared = prepare(df, features, key, number(df, target), one_hot=method == "rf")
    _enough(prepared.rows, 20 if method == "gbt" else 30, method)
    if method == "gbt":
        return boosted(prepared, key, False, trees, depth or DEPTH, [holdout], 1.0)[0]
    learner = RandomForestRegressor(featuresCol="features", labelCol="target", numTrees=trees, maxDepth=depth or 10, seed=42)
    rows = prepared.rows
    model = Pipeline(stages=[*prepared.stages, learner]).fit(rows.where(F.col("fold") != holdout))
    scored = model.transform(rows.where(F.col("fold") == holdout)).select(*key, F.col("target").alias("actual"), F.col("prediction").alias("predicted"))
    return Fitted(model, scored, prepared.columns, {}, rows)


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """One row: R squared, RMSE and rows."""
    miss = F.col("actual") - F.col("predicted")
    return predictions.agg(F.sum(miss * miss).alias("ss"), (F.var_pop("actual") * F.count("actual")).alias("total"), F.count("*").alias("test_rows")).select(
        F.round(1 - F.try_divide(F.col("ss"), F.col("total")), 4).alias("r2_score"), F.round(F.sqrt(F.col("ss") / F.col("test_rows")), 2).alias("rmse"), "test_rows")


def importances(fitted: Fitted, top: int = 10) -> DataFrame:
    """A fitted model's feature importances, one-hot levels added up, largest first."""
    totals: dict[str, float] = {c: 0.0 for c in fitted.columns}
    if isinstance(fitted.model, BoostedModel):
        names, shares = fitted.model.feature_of(), list(fitted.model.trees.importance().values())
    else:
        learner = next(s for s in reversed(fitted.model.stages) if hasattr(s, "featureImportances"))
        names, shares = _vector_names(fitted), learner.featureImportances.toArray()
    for index, value in enumerate(shares):
        totals[names[index] if index < len(names) else fitted.columns[-1]] += float(value)
    rows = sorted(totals.items(), key=lambda i: (-i[1], i[0]))[:top]
    spark = fitted.predictions.sparkSession
    return spark.createDataFrame([(c, round(v, 6), i + 1) for i, (c, v) in enumerate(rows)], "feature string, importance double, rank int")


def _vector_names(fitted: Fitted) -> list[str]:
    """The column behind each slot of the feature vector."""
    from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler

    widths = {}
    indexers = {s.getOutputCol(): len(s.labels) + 1 for s in fitted.model.stages if isinstance(s, StringIndexerModel)}
    for stage in fitted.model.stages:
        if isinstance(stage, OneHotEncoderModel):
            widths.update({o: indexers[i] for i, o in zip(stage.getInputCols(), stage.getOutputCols())})
    assembler = next(s for s in fitted.model.stages if isinstance(s, VectorAssembler))
    return [c[2:] for c in assembler.getInputCols() for _ in range(widths.get(c, 1))]


def ordinary_least_squares(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """In-sample least squares: ``term, coefficient, r2_score, rows_used``.

    The normal equations need one pass: sums of products per pair of columns.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    clean = df.select(number(df, target).alias("target"), *[number(df, c).alias(f"n_{c}") for c in features]).dropna()
    rows = VectorAssembler(inputCols=[f"n_{c}" for c in features], outputCol="features").transform(clean).select("target", "features")
    model = LinearRegression(labelCol="target", solver="normal", regParam=0.0).fit(rows)
    used = int(model.summary.numInstances)
    if used < 5:
        raise ValueError(f"least squares needs at least 5 complete rows, got {used}")
    terms = [("intercept", float(model.intercept))] + [(c, float(v)) for c, v in zip(features, model.coefficients.toArray())]
    r2 = round(float(model.summary.r2), 4)
    return df.sparkSession.createDataFrame([(n, round(v, 4), r2, used) for n, v in terms], "term string, coefficient double, r2_score double, rows_used bigint")


def cross_validate(df: DataFrame, target: str, features: list[str], key: list[str], method: str = "gbt", trees: int = 200,
                   depth: int | None = None, folds: int = TEST_SHARE) -> DataFrame:
    """Accuracy and macro F1 per fold, each fold predicted by a fit on the others."""
    prepared = prepared_classes(df, target, features, key, method)
    if method == "gbt":
        fits = boosted(prepared, key, True, trees, depth or DEPTH, list(range(folds)), ROW_SHARE)
    else:
        fits = [fit_classifier(df, target, features, key, method, trees, depth, holdout=fold, prepared=prepared) for fold in range(folds)]
    parts = [classification_metrics(f.predictions).withColumn("fold", F.lit(fold)) for fold, f in enumerate(fits)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def save_model(fitted: Fitted, path: str) -> None:
    if isinstance(fitted.model, BoostedModel):
        fitted.model.save(fitted.predictions.sparkSession, path)
    else:
        fitted.model.write().overwrite().save(path)


def load_model(path: str, spark: SparkSession | None = None) -> PipelineModel | BoostedModel:
    """A saved model. A new thread has no active session until it is given one, so callers that have a session pass it."""
    spark = spark or SparkSession.active()
    return BoostedModel.load(spark, path) if exists(spark, f"{path}/boosted") else PipelineModel.read().session(spark).load(path)


def stored(df: DataFrame, settings: dict[str, Any], fit: Callable[[], Fitted]) -> tuple[Fitted, str]:
    """The fit saved in the shared folder under a digest of the rows and the settings, or a new one that is saved there, and where it is.

    The digest adds up hashes of the rows, so it does not depend on their order. ``drop_saved`` removes the whole fit; the next
    call then fits anew.
    """
    spark = df.sparkSession
    sums = df.select(*row_digest(df)).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("_h1", "_h2")]).first()
    digest = hashlib.sha256(json.dumps([list(map(str, sums)), settings], sort_keys=True, default=str).encode()).hexdigest()
    path = f"{shared_folder(spark)}/gridsight/fit-{digest}"
    if not exists(spark, f"{path}/facts/_SUCCESS"):
        fitted = fit()
        kept_at(path)
        save_model(fitted, f"{path}/model")
        fitted.predictions.write.mode("overwrite").parquet(f"{path}/predictions")
        fitted.rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(fitted.columns,)], "columns array<string>").write.mode("overwrite").parquet(f"{path}/facts")
    columns = spark.read.parquet(f"{path}/facts").first()["columns"]
    return Fitted(load_model(f"{path}/model", spark), spark.read.parquet(f"{path}/predictions"), list(columns), {}, spark.read.parquet(f"{path}/rows")), path


def lagged_forecast(series: DataFrame, keys: list[str], trees: int = 200, depth: int = DEPTH, lags: int = 3) -> Fitted:
    """Boosted trees on lagged values and the month, one model over all series."""
    from gridsight.operators.timeseries import lag_features

    rows = lag_features(series, keys, lags).dropna().withColumn("_key", F.concat_ws("|", *keys, F.col("ds").cast("string")))
    return fit_regressor(rows, "y", [*[f"lag_{i}" for i in range(1, lags + 1)], "month_of_year", *keys], ["_key"], "gbt", trees, depth)


def recursive_forecast(fitted: Fitted, series: DataFrame, keys: list[str], periods: int = 6, lags: int = 3, width: float = 1.2816) -> DataFrame:
    """``keys…, h, ds, yhat, yhat_lower, yhat_upper, trend_direction`` by a model of ``lagged_forecast``.

    Each period is predicted from the values before it, predicted ones included, so periods follow each other as columns of one
    row per series; nothing is shuffled between them. The band is the error on the held-out fold times ``width`` (80 %).
    A series of fewer than ``lags`` points has no forecast.
    """
    from gridsight.operators.timeseries import series_direction, series_tail

    kind = kinds(series)
    state = series_tail(series, keys, lags).where(F.col("n") >= lags).withColumns({
        **{f"n_lag_{i}": F.col(f"back_{i}") for i in range(1, lags + 1)},
        **{f"n_{k}": number(series, k) for k in keys if kind[k] in ("number", "boolean")},
        **{f"w_{k}": F.coalesce(as_text(series, k), F.lit("Unknown")) for k in keys if kind[k] not in ("number", "boolean")}})
    state = fitted.model.coded(state)
    error = regression_metrics(fitted.predictions).first()["rmse"] or 0.0
    for h in range(1, periods + 1):
        ahead = F.date_add("last_ds", F.floor(F.col("step") * h).cast("int"))
        state = state.withColumns({f"_ds{h}": ahead, "n_month_of_year": F.month(ahead).cast("double")})
        state = boosting.predict(state, fitted.model.trees, state.columns).drop("margins").withColumnRenamed("predicted", f"_y{h}")
        state = state.withColumns({f"n_lag_{i}": F.col(f"n_lag_{i - 1}") if i > 1 else F.col(f"_y{h}") for i in range(1, lags + 1)})
    steps = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_ds{h}").alias("ds"), F.col(f"_y{h}").alias("y")) for h in range(1, periods + 1)])).alias("s")
    value = lambda c: F.round(c, 2)
    return state.select(*keys, series_direction(F.col("first_y"), F.col(f"_y{periods}")).alias("trend_direction"), steps).select(
        *keys, "s.h", "s.ds", value(F.col("s.y")).alias("yhat"), value(F.col("s.y") - width * error).alias("yhat_lower"),
        value(F.col("s.y") + width * error).alias("yhat_upper"), "trend_direction")
