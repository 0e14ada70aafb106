"""Outlier flags by deviation, fences, median deviation and isolation trees.

Every detector works on the same frame: numbers from the feature columns, rows with no
number at all dropped, remaining gaps filled with the column's median. Results are the
flagged rows, most severe first, with the score the flag is based on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridsight.functions.parsing import number
from gridsight.functions.quantiles import medians, quantile_values
from gridsight.functions.scale import saved, spread

CONTAMINATION = 0.05


def _usable(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    numbers = [number(df, c).alias(f"f{i}") for i, c in enumerate(features)]
    any_value = F.coalesce(*[F.col(f"f{i}") for i in range(len(features))])
    return df.select(*keep, *numbers).where(any_value.isNotNull())


def feature_frame(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """``keep…`` and ``f0, f1, …``: usable rows with gaps filled by medians."""
    names = [f"f{i}" for i in range(len(features))]
    kept = _usable(df, features, keep)
    holes = kept.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    gaps = [n for n in names if holes[n]]
    if not gaps:
        return kept
    return kept.fillna({n: v for n, v in medians(kept, gaps).items() if v is not None})


def _deviations(frame: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    row = frame.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    return {n: (row[f"m_{n}"], row[f"s_{n}"]) for n in names}


def _largest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def _report(scored: DataFrame, features: list[str], keep: list[str], flag: Column, score: Column,
            severe_first: Column) -> DataFrame:
    names = [f"f{i}" for i in range(len(features))]
    return (scored.where(flag).select(*keep, *[F.round(n, 4).alias(c) for n, c in zip(names, features) if c not in keep],
                                      F.round(score, 4).alias("anomaly_score"), severe_first.alias("_s"))
            .orderBy(F.desc("_s"), *keep).drop("_s"))


def zscore(df: DataFrame, features: list[str], keep: list[str] = (), threshold: float = 3.0) -> DataFrame:
    """Rows with any feature over ``threshold`` population deviations from its mean."""
    frame, names = feature_frame(df, features, keep), [f"f{i}" for i in range(len(features))]
    stats = _deviations(frame, names)
    z = [F.abs((F.col(n) - m) / s) if s else F.lit(0.0) for n, (m, s) in stats.items()]
    # A spread too large for a double gives NaN, which flags nothing.
    scored = frame.withColumn("_z", F.nanvl(_largest(z), F.lit(0.0)))
    return _report(scored, features, list(keep), F.col("_z") > threshold, -F.col("_z"), F.col("_z"))


outliers = zscore


def iqr(df: DataFrame, features: list[str], keep: list[str] = (), multiplier: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences; the score is the distance in quartile ranges."""
    frame, names = feature_frame(df, features, keep), [f"f{i}" for i in range(len(features))]
    q = quantile_values(frame, names, [0.25, 0.75])
    distances = []
    for n in names:
        low, high = q[n][0.25], q[n][0.75]
        width = high - low
        if width > 0:
            distances += [(low - multiplier * width - F.col(n)) / width, (F.col(n) - (high + multiplier * width)) / width]
    scored = frame.withColumn("_d", F.nanvl(_largest(distances), F.lit(0.0)) if distances else F.lit(0.0))
    return _report(scored, features, list(keep), F.col("_d") > 0, F.col("_d"), F.col("_d"))


def modified_zscore(df: DataFrame, features: list[str], keep: list[str] = (), threshold: float = 3.5) -> DataFrame:
    """Deviation from the median in units of the median absolute deviation."""
    names = [f"f{i}" for i in range(len(features))]
    raw = _usable(df, features, list(keep))
    # Filling gaps with the median leaves the median where it is: one pass serves both.
    middle = medians(raw, names)
    frame = raw.fillna({n: v for n, v in middle.items() if v is not None})
    away = frame.select(*[F.abs(F.col(n) - middle[n]).alias(n) for n in names])
    mad = medians(away, names)
    z = [F.abs(0.6745 * (F.col(n) - middle[n]) / mad[n]) if mad[n] else F.lit(0.0) for n in names]
    scored = frame.withColumn("_z", F.nanvl(_largest(z), F.lit(0.0)))
    return _report(scored, features, list(keep), F.col("_z") > threshold, -F.col("_z"), F.col("_z"))


def anomaly_summary(df: DataFrame, anomalies: DataFrame, features: list[str]) -> DataFrame:
    """One row: usable records, flagged records and their rate in per cent."""
    total = df.where(F.coalesce(*[number(df, c) for c in features]).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return anomalies.agg(F.count(F.lit(1)).alias("anomaly_count")).select(total.alias("total_records"), "anomaly_count").withColumn(
        "anomaly_rate_pct", F.round(F.coalesce(F.try_divide(F.col("anomaly_count").cast("double"), F.col("total_records").cast("double")), F.lit(0.0)) * 100, 2))


# --- Isolation forest --------------------------------------------------------------

TREE_ROWS = 256
_NODE = "tree int, node int, feature int, cut double, size int"


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, int]]:
    """Random splits of one sample: ``(node, feature, cut, size)``, feature -1 for a leaf."""
    nodes, stack = [], [(0, np.arange(len(rows)), 0)]
    while stack:
        node, index, depth = stack.pop()
        low, high = (rows[index].min(axis=0), rows[index].max(axis=0)) if len(index) else (None, None)
        usable = np.flatnonzero(high > low) if len(index) > 1 else []
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, len(index)))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append((node, feature, cut, len(index)))
        left = rows[index, feature] < cut
        stack += [(2 * node + 1, index[left], depth + 1), (2 * node + 2, index[~left], depth + 1)]
    return nodes


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    path = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, path))


def fit_forest(df: DataFrame, features: list[str], key: str, trees: int = 200, rows: int = TREE_ROWS,
               seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The forest's nodes and the scaling of its features, as two small tables.

    Sampling is the method's own: each tree grows on at most ``rows`` rows. Every row
    draws one or more trees by hash and a priority; a tree keeps the rows of lowest
    priority, cut below the shuffle, so no tree sees more than it grows on.
    """
    frame, names = feature_frame(df, features, [key]), [f"f{i}" for i in range(len(features))]
    stats = _deviations(frame, names)
    total = frame.count()
    if total < 10:
        raise ValueError(f"isolation forest needs at least 10 rows, got {total}")
    draws = min(trees, -(-trees * rows * 3 // (2 * total)))
    # Far more rows than the trees hold: let most leave before the shuffle.
    keep_share = min(1.0, trees * rows * 4.0 / (total * draws))
    scaled = frame.select(key, *[((F.col(n) - m) / (s or 1.0)).alias(n) for n, (m, s) in stats.items()])
    drawn = (
        scaled.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("_base", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(trees)))
        .withColumn("tree", F.pmod(F.col("_base") + F.col("_draw") * max(1, trees // draws), F.lit(trees)).cast("int"))
        .withColumn("_p", F.xxhash64(F.lit(seed + 1), "_draw", key))
    )
    if keep_share < 1.0:
        drawn = drawn.where(F.pmod("_p", F.lit(1_000_000)) < int(keep_share * 1_000_000))
    order = W.partitionBy("tree").orderBy("_p", key)
    sample = drawn.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= rows).select("tree", "_i", *names)
    limit = int(np.ceil(np.log2(max(min(rows, total), 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = pdf.sort_values("_i")[names].to_numpy(dtype=float)
        nodes = _grow(values, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "size"])

    nodes = sample.groupBy("tree").applyInPandas(grow, _NODE)
    spark: SparkSession = df.sparkSession
    scaling = spark.createDataFrame(
        [(i, c, float(stats[n][0]), float(stats[n][1] or 1.0)) for i, (c, n) in enumerate(zip(features, names))],
        "place int, feature string, mean double, deviation double")
    return nodes, scaling


def score_forest(df: DataFrame, nodes: DataFrame, scaling: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Adds ``anomaly_score`` (more negative is more anomalous) using a saved forest.

    The forest is bounded by its own size (trees x 511 nodes) and travels to the tasks
    as a broadcast value; rows are scored batch by batch.
    """
    plan = sorted(scaling.collect(), key=lambda r: r["place"])
    features = [r["feature"] for r in plan]
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"the forest needs columns the table lacks: {absent}")
    table = nodes.toPandas()
    trees = []
    for _, part in table.groupby("tree"):
        width = int(part["node"].max()) + 1
        feature, cut, size = np.full(width, -1), np.zeros(width), np.zeros(width)
        at = part["node"].to_numpy()
        feature[at], cut[at], size[at] = part["feature"], part["cut"], part["size"]
        trees.append((feature, cut, size))
    root = np.mean([t[2][0] for t in trees])
    forest = df.sparkSession.sparkContext.broadcast((trees, float(_mean_path(root))))

    def paths(values: np.ndarray) -> np.ndarray:
        grown, normal = forest.value
        total = np.zeros(len(values))
        for feature, cut, size in grown:
            node, depth = np.zeros(len(values), dtype=int), np.zeros(len(values))
            open_rows = np.flatnonzero(feature[node] >= 0)
            while len(open_rows):
                at = node[open_rows]
                right = values[open_rows, feature[at]] >= cut[at]
                node[open_rows] = 2 * at + 1 + right
                depth[open_rows] += 1
                open_rows = open_rows[feature[node[open_rows]] >= 0]
            total += depth + _mean_path(size[node])
        return -np.power(2.0, -(total / len(grown)) / normal)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(paths(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    frame = spread(feature_frame(df, features, list(keep)))
    scaled = [(F.col(f"f{r['place']}") - r["mean"]) / r["deviation"] for r in plan]
    return frame.withColumn("anomaly_score", score(*scaled)).select(
        *keep, *[F.col(f"f{i}").alias(c) for i, c in enumerate(features) if c not in keep], "anomaly_score")


def forest_anomalies(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """The share ``contamination`` of rows with the lowest scores, lowest first."""
    fixed = saved(scored)
    cut = quantile_values(fixed, ["anomaly_score"], [contamination])["anomaly_score"][contamination]
    return fixed.where(F.col("anomaly_score") < cut).orderBy("anomaly_score")


# --- One-class boundary ------------------------------------------------------------

#: Rows whose cosines are worked out at a time, so that they stay in a core's cache.
BLOCK = 1024


def wave_sums(values: np.ndarray, omega: np.ndarray, phase: np.ndarray, weights: np.ndarray, offset: float) -> tuple[np.ndarray, int]:
    """Of the rows whose margin is below ``offset``: the sum of their random features, and how many there are.

    Whole turns are taken off the angles in double precision; the cosine of the rest is one of single precision, several times as
    fast and right to about 1e-7. Sums over blocks are doubles.
    """
    waves, height = len(phase), np.sqrt(2.0 / len(phase))
    turns, start, weights = omega / (2 * np.pi), phase / (2 * np.pi), (weights * height).astype(np.float32)
    angles, whole, phi = np.empty((BLOCK, waves)), np.empty((BLOCK, waves)), np.empty((BLOCK, waves), np.float32)
    below, inside = np.zeros(waves), 0
    for begin in range(0, len(values), BLOCK):
        rows = values[begin:begin + BLOCK]
        t, w, p = angles[:len(rows)], whole[:len(rows)], phi[:len(rows)]
        np.matmul(rows, turns, out=t)
        t += start
        t -= np.rint(t, out=w)
        np.multiply(t, 2 * np.pi, out=p, casting="unsafe")
        np.cos(p, out=p)
        short = p @ weights < offset
        below += short.astype(np.float32) @ p
        inside += int(short.sum())
    return below * height, inside


def one_class_boundary(df: DataFrame, features: list[str], keep: list[str] = (), nu: float = 0.05, waves: int = 128,
                       rounds: int = 25, seed: int = 7) -> DataFrame:
    """One-class support vector boundary with a radial kernel, on random Fourier features.

    The kernel is replaced by ``waves`` random cosines, which makes the problem linear:
    each round is one pass that returns a partial gradient per partition. The offset is
    set to the ``nu`` quantile of the margins, the property a one-class machine has at
    its optimum. Approximate in the kernel and the number of rounds, never in the rows.
    """
    frame, names = feature_frame(df, features, list(keep)), [f"f{i}" for i in range(len(features))]
    stats = _deviations(frame, names)
    scaled = spread(frame).select(*keep, *names, *[((F.col(n) - m) / (s or 1.0)).alias(f"z{i}") for i, (n, (m, s)) in enumerate(stats.items())])
    columns = [f"z{i}" for i in range(len(names))]

    def pack(batches):
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([values.astype(np.float64).tobytes()], pa.binary())], ["z"])

    # Every round reads the scaled rows: a batch of them is the bytes of one value.
    rows = saved(scaled.select(*columns).mapInArrow(pack, "z binary"))
    rng = np.random.default_rng(seed)
    # gamma = 1 / d on unit-variance features.
    omega = rng.normal(scale=np.sqrt(2.0 / len(names)), size=(len(names), waves))
    phase = rng.uniform(0, 2 * np.pi, size=waves)
    project = lambda values: np.sqrt(2.0 / waves) * np.cos(values @ omega + phase)

    def gradient(weights: np.ndarray, offset: float):
        def run(batches):
            below, count, inside = np.zeros(waves), 0, 0
            for value in (v for batch in batches for v in batch.column(0)):
                values = np.frombuffer(value.as_buffer(), np.float64).reshape(-1, len(columns))
                found, short = wave_sums(values, omega, phase, weights, offset)
                below, count, inside = below + found, count + len(values), inside + short
            yield pa.RecordBatch.from_arrays([pa.array([below.tolist()]), pa.array([count]), pa.array([inside])], ["g", "n", "m"])

        parts = rows.mapInArrow(run, "g array<double>, n bigint, m bigint")
        # One row of ``waves`` numbers a task.
        found = parts.collect()
        return np.sum([np.zeros(waves), *(r["g"] for r in found)], axis=0), sum(r["n"] for r in found), sum(r["m"] for r in found)

    # Start from the mean feature vector: every row counts as below an infinite offset.
    total, count, _ = gradient(np.zeros(waves), np.inf)
    weights, offset = total / count, 0.0
    offset = float(weights @ weights)
    for step in range(1, rounds + 1):
        below, count, short = gradient(weights, offset)
        rate = 1.0 / (step + 1)
        weights = weights - rate * (weights - below / (nu * count))
        offset = offset - rate * (short / (nu * count) - 1) * abs(offset)

    @F.pandas_udf("double")
    def margin(*z: pd.Series) -> pd.Series:
        return pd.Series(project(np.column_stack([c.to_numpy(dtype=float) for c in z])) @ weights)

    scored = saved(scaled.withColumn("_margin", margin(*columns)))
    cut = quantile_values(scored, ["_margin"], [nu])["_margin"][nu]
    return _report(scored, features, list(keep), F.col("_margin") < cut, F.lit(cut) - F.col("_margin"), F.lit(cut) - F.col("_margin"))
