"""Clusters: K-means and assignment to fixed centres, DBSCAN, Ward on micro-clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.scale import broadcast_checked, row_numbers, saved, spread
from gridsight.operators.anomaly import _deviations, feature_frame
from gridsight.operators.segment import risk_label


def _scaled(df: DataFrame, features: list[str], keep: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """``keep…, f0…`` as given (gaps filled) and ``z0…`` with mean 0, population deviation 1."""
    frame, names = feature_frame(df, features, list(keep)), [f"f{i}" for i in range(len(features))]
    stats = _deviations(frame, names)
    scaled = frame.select("*", *[((F.col(n) - m) / (s or 1.0)).alias(f"z{i}") for i, (n, (m, s)) in enumerate(stats.items())])
    return scaled, stats


def _vector(count: int):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[f"z{i}" for i in range(count)], outputCol="features")


def fit_kmeans(df: DataFrame, features: list[str], k: int = 3, seed: int = 42, rounds: int = 20) -> DataFrame:
    """Cluster centres as a table: ``cluster``, one column per feature, ``mean_i`` and
    ``deviation_i`` of the scaling. Clusters are numbered in the order of their centres."""
    from pyspark.ml.clustering import KMeans

    scaled, stats = _scaled(df, features, [])
    # Every round reads the vectors; keep them where memory allows.
    vectors = _vector(len(features)).transform(spread(scaled)).select("features").persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=rounds).fit(vectors)
    finally:
        vectors.unpersist()
    moments = list(stats.values())
    centres = sorted([[float(v) for v in c] for c in model.clusterCenters()])
    rows = [(i, *[c[j] * (s or 1.0) + m for j, (m, s) in enumerate(moments)], *[x for m, s in moments for x in (float(m), float(s or 1.0))])
            for i, c in enumerate(centres)]
    schema = ", ".join(["cluster int", *[f"`{f}` double" for f in features],
                        *[f"mean_{i} double, deviation_{i} double" for i in range(len(features))]])
    return df.sparkSession.createDataFrame(rows, schema)


def assign_clusters(df: DataFrame, centres: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """The nearest centre of each row in scaled space, ties to the lower number.

    The centres are k rows; they become one literal expression, not a join.
    """
    table = sorted(centres.collect(), key=lambda r: r["cluster"])
    first = table[0]
    frame = feature_frame(df, features, list(keep))
    distances = []
    for row in table:
        parts = [F.pow((F.col(f"f{i}") - F.lit(row[f])) / F.lit(first[f"deviation_{i}"]), 2) for i, f in enumerate(features)]
        distances.append(F.struct(reduce(lambda a, b: a + b, parts).alias("d"), F.lit(row["cluster"]).alias("cluster")))
    nearest = F.array_min(F.array(*distances))["cluster"]
    return frame.select(*keep, *[F.col(f"f{i}").alias(f) for i, f in enumerate(features) if f not in keep], nearest.alias("cluster"))


def cluster_profiles(assigned: DataFrame, features: list[str], ratio: str | None = None) -> DataFrame:
    """Size and feature means per cluster, with a risk label where a ratio is named."""
    out = assigned.groupBy("cluster").agg(F.count("*").alias("count"), *[F.round(F.avg(f), 2).alias(f) for f in features])
    label = risk_label(F.col(ratio)) if ratio else F.concat(F.lit("Segment "), F.col("cluster") + 1)
    return out.withColumn("risk_label", label)


# --- DBSCAN ------------------------------------------------------------------------

REFINE_ROUNDS = 12


def dbscan(df: DataFrame, features: list[str], keep: list[str] = (), eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``keep…, features…, cluster`` with noise as -1; the exact DBSCAN clusters.

    Equal rows are one weighted point. Cells of side ``eps / sqrt(d)`` have a diagonal
    of ``eps``: all points of a cell are neighbours, so a cell of ``min_samples`` rows is
    core throughout and never compared within. Only points of sparser cells are
    compared with the cells around them, and there are fewer than ``min_samples`` of
    those per cell. Whether two cells touch is settled on bounding boxes of ever finer
    parts. Clusters are numbered by their smallest point; a border point within reach
    of several clusters joins the one numbered first.
    """
    d = len(features)
    names, scaled_names = [f"f{i}" for i in range(d)], [f"z{i}" for i in range(d)]
    scaled, _ = _scaled(df, features, list(keep))
    side = eps / np.sqrt(d) * (1 - 1e-12)
    cell = [F.floor(F.col(z) / side) for z in scaled_names]
    # Split the grid for refinement: sixteen binary digits below the cell.
    points = saved(
        scaled.groupBy(*names).agg(F.count("*").alias("weight"), *[F.first(z).alias(z) for z in scaled_names])
        .select("*", *[c.alias(f"c{i}") for i, c in enumerate(cell)])
        .withColumn("point", F.array(*scaled_names)))
    cell_key = [f"c{i}" for i in range(d)]
    cells = points.groupBy(*cell_key).agg(F.sum("weight").alias("cell_weight"))
    points = saved(points.join(cells, cell_key).withColumn("dense", F.col("cell_weight") >= min_samples))

    # Cells within reach differ by at most ceil(sqrt(d)) per axis. Two axes are matched
    # by equality on shifted coordinates, the others by a filter.
    reach = int(np.ceil(np.sqrt(d)))
    matched = cell_key[:2]
    shifts = F.array(*[F.struct(*[F.lit(v).alias(f"s{i}") for i, v in enumerate(offset)])
                       for offset in np.ndindex(*[2 * reach + 1] * len(matched))])
    shifted = [(F.col(c) + F.col(f"s.s{i}") - reach).alias(f"m{i}") for i, c in enumerate(matched)]
    on = [f"m{i}" for i in range(len(matched))]
    within = lambda a, b: reduce(lambda x, y: x & y, [F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) <= reach for c in cell_key])
    apart = reduce(lambda a, b: a + b, [(F.col(f"a_{z}") - F.col(f"b_{z}")) * (F.col(f"a_{z}") - F.col(f"b_{z}")) for z in scaled_names])

    sparse = points.where(~F.col("dense"))
    asking = sparse.select("point", "weight", *[F.col(z).alias(f"a_{z}") for z in scaled_names], *[F.col(c).alias(f"a_{c}") for c in cell_key],
                           F.explode(shifts).alias("s"), *matched).select("*", *shifted).drop("s", *matched)
    asked = points.select(F.col("point").alias("other"), F.col("weight").alias("other_weight"), F.col("dense").alias("other_dense"),
                          *[F.col(z).alias(f"b_{z}") for z in scaled_names], *[F.col(c).alias(f"b_{c}") for c in cell_key],
                          *[F.col(c).alias(f"m{i}") for i, c in enumerate(matched)])
    near = (asking.join(asked, on).where(within("a_", "b_") & (apart <= eps * eps))
            .select("point", "other", "other_dense", "other_weight", *[f"b_{c}" for c in cell_key]))
    core_sparse = near.groupBy("point").agg(F.sum("other_weight").alias("around")).where(F.col("around") >= min_samples).select("point")
    core_sparse = saved(core_sparse.withColumn("core_sparse", F.lit(True)))
    points = saved(points.join(core_sparse, "point", "left").withColumn("core", F.col("dense") | F.coalesce("core_sparse", F.lit(False))).drop("core_sparse"))

    links = _touching_cells(points.where("core"), scaled_names, cell_key, matched, reach, eps, side)
    labels = _components(points.where("core").groupBy(*cell_key).agg(F.min("point").alias("label")), links, cell_key)
    core_labels = points.where("core").join(labels, cell_key).select("point", "label")
    border = (near.join(core_labels.withColumnRenamed("point", "other"), "other")
              .join(points.where(~F.col("core")).select("point"), "point", "left_semi")
              .groupBy("point").agg(F.min("label").alias("label")))
    placed = core_labels.unionByName(border)
    # One row per cluster: its smallest point becomes its number.
    found = saved(labels.select("label").distinct())
    numbers = row_numbers(found, [F.asc("label")], "cluster").withColumn("cluster", (F.col("cluster") - 1).cast("int"))
    member = placed.join(broadcast_checked(numbers), "label").select("point", "cluster")
    labelled = points.join(member, "point", "left").select(*names, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return (feature_frame(df, features, list(keep)).join(labelled, names)
            .select(*keep, *[F.col(n).alias(f) for n, f in zip(names, features) if f not in keep], "cluster"))


def _boxes(core: DataFrame, z: list[str], cell_key: list[str], side: float, parts: int) -> DataFrame:
    """Bounding boxes of the core points per ``parts``-th of a cell along each axis."""
    sub = [F.floor((F.col(v) / side - F.col(c)) * parts).cast("int").alias(f"p{i}") for i, (v, c) in enumerate(zip(z, cell_key))]
    keyed = core.select(*cell_key, *sub, *z)
    return keyed.groupBy(*cell_key, *[f"p{i}" for i in range(len(z))]).agg(
        *[F.min(v).alias(f"lo_{v}") for v in z], *[F.max(v).alias(f"hi_{v}") for v in z])


def _touching_cells(core: DataFrame, z: list[str], cell_key: list[str], matched: list[str], reach: int, eps: float, side: float) -> DataFrame:
    """Pairs of cells (``x_c…``, ``y_c…``) holding core points within ``eps`` of each other.

    Pairs of parts whose boxes are surely within or surely beyond ``eps`` are settled;
    the rest are halved again. A part of one distinct point has a box of no size, so
    every pair is settled in the end; at the last round the points themselves decide.
    """
    shifts = F.array(*[F.struct(*[F.lit(v).alias(f"s{i}") for i, v in enumerate(offset)]) for offset in np.ndindex(*[2 * reach + 1] * len(matched))])
    sides = lambda frame, tag: frame.select(*[F.col(c).alias(f"{tag}_{c}") for c in frame.columns])
    cell_cols = [f"{t}_{c}" for t in ("x", "y") for c in cell_key]
    part_cols = [f"{t}_p{i}" for t in ("x", "y") for i in range(len(z))]
    near2 = sum_of([F.greatest(F.lit(0.0), F.col(f"y_lo_{v}") - F.col(f"x_hi_{v}"), F.col(f"x_lo_{v}") - F.col(f"y_hi_{v}")) for v in z])
    far2 = sum_of([F.greatest(F.col(f"y_hi_{v}") - F.col(f"x_lo_{v}"), F.col(f"x_hi_{v}") - F.col(f"y_lo_{v}")) for v in z])

    boxes = saved(_boxes(core, z, cell_key, side, 1))
    left = sides(boxes, "x").withColumn("s", F.explode(shifts)).select(
        "*", *[(F.col(f"x_{c}") + F.col(f"s.s{i}") - reach).alias(f"m{i}") for i, c in enumerate(matched)]).drop("s")
    right = sides(boxes, "y").select("*", *[F.col(f"y_{c}").alias(f"m{i}") for i, c in enumerate(matched)])
    earlier = F.array(*[F.col(f"x_{c}") for c in cell_key]) < F.array(*[F.col(f"y_{c}") for c in cell_key])
    pairs = left.join(right, [f"m{i}" for i in range(len(matched))]).where(earlier & (near2 <= eps * eps))
    found: list[DataFrame] = []
    parts = 1
    for round_ in range(REFINE_ROUNDS + 1):
        pairs = saved(pairs.select(*cell_cols, *part_cols, (far2 <= eps * eps).alias("sure")))
        sure = pairs.where("sure").select(*cell_cols).distinct()
        found.append(sure)
        open_pairs = pairs.where(~F.col("sure")).join(sure, cell_cols, "left_anti").select(*cell_cols, *part_cols)
        open_pairs = saved(open_pairs)
        if open_pairs.isEmpty():
            break
        if round_ == REFINE_ROUNDS:
            found.append(_point_pairs(core, z, cell_key, open_pairs, side, parts, eps, cell_cols))
            break
        coarse = [f"p{i}" for i in range(len(z))]
        finer = _boxes(core, z, cell_key, side, parts * 2)
        finer = saved(finer.withColumns({f"q{i}": F.floor(F.col(p) / 2).cast("int") for i, p in enumerate(coarse)}))
        for tag in ("x", "y"):
            children = sides(finer, tag)
            keys = [F.col(f"o.{tag}_{c}") == F.col(f"n.{tag}_{c}") for c in cell_key]
            keys += [F.col(f"o.{tag}_p{i}") == F.col(f"n.{tag}_q{i}") for i in range(len(z))]
            kept = [f"o.{c}" for c in open_pairs.columns if c not in {f"{tag}_{c}" for c in cell_key} | {f"{tag}_p{i}" for i in range(len(z))}]
            open_pairs = open_pairs.alias("o").join(children.alias("n"), reduce(lambda a, b: a & b, keys)).select(
                *kept, *[f"n.{c}" for c in children.columns if not c.startswith(f"{tag}_q")])
        pairs, parts = open_pairs.where(near2 <= eps * eps), parts * 2
    return saved(reduce(lambda a, b: a.unionByName(b), found).distinct())


def sum_of(gaps: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [g * g for g in gaps])


def _point_pairs(core: DataFrame, z: list[str], cell_key: list[str], pairs: DataFrame, side: float, parts: int, eps: float, cell_cols: list[str]) -> DataFrame:
    sub = [F.floor((F.col(v) / side - F.col(c)) * parts).cast("int").alias(f"p{i}") for i, (v, c) in enumerate(zip(z, cell_key))]
    keyed = core.select(*cell_key, *sub, *z)
    x = keyed.select(*[F.col(c).alias(f"x_{c}") for c in keyed.columns])
    y = keyed.select(*[F.col(c).alias(f"y_{c}") for c in keyed.columns])
    keys = lambda tag: [f"{tag}_{c}" for c in cell_key] + [f"{tag}_p{i}" for i in range(len(z))]
    apart = sum_of([F.col(f"x_{v}") - F.col(f"y_{v}") for v in z])
    return pairs.join(x, keys("x")).join(y, keys("y")).where(apart <= eps * eps).select(*cell_cols).distinct()


def _components(cells: DataFrame, links: DataFrame, cell_key: list[str]) -> DataFrame:
    """The smallest label reachable from each cell, by repeated minimum and shortcut.

    A round takes the least label among a cell and its neighbours, then the label of
    the cell that label came from, so the rounds grow with the logarithm of the
    longest chain. Each round is saved.
    """
    both = links.select(*[F.col(f"x_{c}").alias(c) for c in cell_key], F.array(*[F.col(f"y_{c}") for c in cell_key]).alias("next")).unionByName(
        links.select(*[F.col(f"y_{c}").alias(c) for c in cell_key], F.array(*[F.col(f"x_{c}") for c in cell_key]).alias("next")))
    edges = saved(both.select(F.array(*cell_key).alias("cell"), "next"))
    state = saved(cells.select(F.array(*cell_key).alias("cell"), F.col("label").alias("start"), "label"))
    while True:
        seen = edges.join(state.select(F.col("cell").alias("next"), F.col("label").alias("theirs")), "next").groupBy("cell").agg(F.min("theirs").alias("theirs"))
        lower = saved(state.join(seen, "cell", "left").withColumn("new", F.least("label", F.coalesce("theirs", "label"))).drop("theirs"))
        # A label is the starting label of some cell; follow that cell's own label.
        jump = lower.select(F.col("start").alias("new"), F.col("new").alias("further"))
        after = saved(lower.join(jump, "new", "left").select(
            "cell", "start", "label", F.least("new", F.coalesce("further", "new")).alias("new")))
        changed = not after.where(F.col("new") != F.col("label")).isEmpty()
        state = after.select("cell", "start", F.col("new").alias("label"))
        if not changed:
            return state.select(*[F.col("cell")[i].alias(c) for i, c in enumerate(cell_key)], "label")


# --- Ward --------------------------------------------------------------------------

MICRO_CLUSTERS = 200


def ward(df: DataFrame, features: list[str], keep: list[str] = (), k: int = 3, micro: int = MICRO_CLUSTERS,
         seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Agglomerative clusters and the last ten merge heights.

    The rows are first gathered into at most ``micro`` K-means groups on Spark; Ward's
    merging then runs over those weighted centres, a few hundred numbers. Approximate
    where a group straddles a boundary.
    """
    scaled, _ = _scaled(df, features, list(keep))
    z = [f"z{i}" for i in range(len(features))]
    distinct = scaled.select(*z).distinct().limit(micro + 1).count()
    from pyspark.ml.clustering import KMeans

    vectors = _vector(len(features)).transform(spread(scaled))
    model = KMeans(k=max(2, min(micro, distinct)), seed=seed, maxIter=20).fit(vectors)
    grouped = model.transform(vectors).drop("features")
    rows = grouped.groupBy("prediction").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in z]).collect()
    groups = {r["prediction"]: (r["n"], np.array([r[c] for c in z]), [r["prediction"]]) for r in rows}
    heights: list[float] = []
    while len(groups) > 1:
        keys = list(groups)
        n = np.array([groups[g][0] for g in keys], dtype=float)
        centres = np.array([groups[g][1] for g in keys])
        d2 = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(-1)
        cost = 2 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * d2
        cost[np.triu_indices(len(keys))[::-1]] = np.inf
        np.fill_diagonal(cost, np.inf)
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        heights.append(float(np.sqrt(cost[i, j])))
        if len(groups) == k:
            final = {g: v for g, v in groups.items()}
        a, b = groups.pop(keys[i]), groups.pop(keys[j])
        total = a[0] + b[0]
        groups[min(keys[i], keys[j])] = (total, (a[0] * a[1] + b[0] * b[1]) / total, a[2] + b[2])
    if len(rows) < k:
        final = {r["prediction"]: (r["n"], np.array([r[c] for c in z]), [r["prediction"]]) for r in rows}
    elif k == 1:
        final = groups
    ordered = sorted(final.values(), key=lambda v: tuple(v[1]))
    lookup = {member: i for i, v in enumerate(ordered) for member in v[2]}
    mapping = F.create_map(*[F.lit(x) for item in lookup.items() for x in item])
    labelled = grouped.select(*keep, *[F.col(f"f{i}").alias(f) for i, f in enumerate(features) if f not in keep],
                              mapping[F.col("prediction")].alias("cluster"))
    last = heights[-min(10, len(heights)):]
    merges = df.sparkSession.createDataFrame([(i + 1, round(v, 4)) for i, v in enumerate(last)], "merge int, height double")
    return labelled, merges
