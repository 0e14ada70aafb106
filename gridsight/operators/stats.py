"""Correlation, distribution, contingency and frequent itemsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridsight.functions.parsing import as_text, missing, number
from gridsight.functions.quantiles import quantiles
from gridsight.functions.scale import BROADCAST_ROWS, running_totals, saved
from gridsight.functions.tails import p_value
from gridsight.operators.charts import histogram


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def pearson(df: DataFrame, columns: list[str], with_p: bool = True) -> DataFrame:
    """Correlation of every pair over the rows where both are numbers, strongest first.

    One scan for the means and one for all co-moments about them, however many columns: each task
    multiplies its batches by themselves and sends one row per pair.
    """
    numbers = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"x{i}") for i in range(len(columns))]).first()
    centre = np.array(list(means), float)
    upper = np.triu_indices(len(columns), 1)

    def moments(batches):
        sums = np.zeros((6, len(upper[0])))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - centre
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            parts = [there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x]
            sums += [p[upper] for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), *(pa.array(s) for s in sums)], ["pair", "n", "sx", "sy", "sxx", "syy", "sxy"])

    schema = "pair bigint, n double, sx double, sy double, sxx double, syy double, sxy double"
    one = numbers.mapInArrow(moments, schema).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    r = F.when(spread > 0, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_pairs(columns))], "pair bigint, column_a string, column_b string")
    return _correlations(one.where("n > 0").join(F.broadcast(names), "pair").select("column_a", "column_b", F.col("n").cast("bigint").alias("n"), r.alias("r")), with_p)


def _correlations(pairs: DataFrame, with_p: bool) -> DataFrame:
    """Pairs of at least three rows, correlation and p-value to four decimals."""
    kept = pairs.where(F.col("n") >= 3).withColumn("correlation", F.round(F.when(~F.isnan("r"), F.col("r")), 4))
    columns = ["column_a", "column_b", "n", "correlation"]
    if with_p:
        kept = kept.withColumn("p_value", F.round(p_value("r", "n"), 4))
        columns.append("p_value")
    return kept.orderBy(F.desc_nulls_last(F.abs("correlation")), "column_a", "column_b").select(*columns)


def spearman(df: DataFrame, columns: list[str], with_p: bool = True) -> DataFrame:
    """Rank correlation of every pair over the rows where both are numbers.

    Pairs whose rows are the same (they miss the same columns' gaps) share one pass. A
    value's average rank is the number of rows below it plus half its own, read off
    value counts; ranks are joined back by value and all pairs correlate in one aggregate.
    """
    pairs = _pairs(columns)
    numbers = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    holes = numbers.agg(*[F.count_if(F.col(f"x{i}").isNull()).alias(f"x{i}") for i in range(len(columns))]).first()
    gappy = {c for i, c in enumerate(columns) if holes[f"x{i}"]}
    groups: dict[frozenset[str], list[tuple[str, str]]] = {}
    for pair in pairs:
        groups.setdefault(frozenset(gappy & set(pair)), []).append(pair)
    out = None
    for gaps, members in groups.items():
        part = _rank_correlations(numbers, columns, sorted(gaps), members)
        out = part if out is None else out.unionByName(part)
    return _correlations(out, with_p)


def _rank_correlations(numbers: DataFrame, columns: list[str], gaps: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlation of the average ranks of each pair over the rows without the gaps."""
    names = {c: f"x{columns.index(c)}" for pair in pairs for c in pair}
    kept = numbers.select(*names.values())
    if gaps:
        kept = kept.dropna(subset=[names[c] for c in gaps])
    counts = None
    for n in names.values():
        mine = kept.groupBy(F.lit(n).alias("side"), F.col(n).alias("v")).agg(F.count("*").alias("w"))
        counts = mine if counts is None else counts.unionByName(mine)
    upto = running_totals(counts, ["side"], "v", "w", "upto")
    ranks = saved(upto.select("side", "v", (F.col("upto") - F.col("w") + (F.col("w") + 1) / 2).alias("rank")))
    sizes = {r["side"]: r["count"] for r in ranks.groupBy("side").count().collect()}
    for n in names.values():
        mine = ranks.where(F.col("side") == n).select(F.col("v").alias(n), F.col("rank").alias(f"r{n}"))
        # Few distinct values: the ranks travel to the rows and the rows stay in place.
        kept = kept.join(F.broadcast(mine) if sizes.get(n, 0) <= BROADCAST_ROWS else mine, n)
    one = kept.agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"r{names[a]}", f"r{names[b]}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select("n", F.explode(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*", "n")


def distribution(df: DataFrame, metric: str) -> DataFrame:
    """One row: count, mean, population deviation, range and five percentiles."""
    x = number(df, metric)
    names = {0.05: "p5", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.95: "p95"}
    q = quantiles(df, [metric], list(names)).agg(F.struct(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()]).alias("q"))
    return df.agg(F.count(x).alias("count"), F.round(F.avg(x), 2).alias("mean"), F.round(F.stddev_pop(x), 2).alias("std"),
                  F.round(F.min(x), 2).alias("min"), F.round(F.max(x), 2).alias("max")).where(F.col("count") >= 2).select(
        "*", q.scalar().alias("q")).select("count", "mean", "std", "min", "max",
                                           *[F.round(f"q.{n}", 2).alias(n) for n in names.values()])


def distribution_bins(df: DataFrame, metric: str, bins: int = 10) -> DataFrame:
    """Histogram of at most ``bins`` bins, fewer where there are fewer distinct values."""
    x = number(df, metric)
    distinct = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*")).limit(bins).agg(F.count(F.lit(1))).scalar()
    return histogram(df, metric, bins=F.greatest(F.lit(1), F.least(F.lit(bins), distinct)))


def distribution_by(df: DataFrame, metric: str, dimension: str) -> DataFrame:
    """Mean, sample deviation and count per group."""
    x = number(df, metric)
    return (df.where(~missing(df, dimension) & x.isNotNull()).groupBy(as_text(df, dimension).alias("label"))
            .agg(F.round(F.avg(x), 2).alias("mean"), F.round(F.stddev_samp(x), 2).alias("std"), F.count("*").alias("count")))


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Joint counts of every pair of dimensions and the share within the first value."""
    pairs = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                               F.when(~missing(df, a), as_text(df, a)).alias("value_a"),
                               F.when(~missing(df, b), as_text(df, b)).alias("value_b")) for a, b in _pairs(columns)])
    keys = ["column_a", "column_b", "value_a"]
    joint = (df.select(F.explode(pairs).alias("p")).select("p.*")
             .where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())
             .groupBy(*keys, "value_b").agg(F.count("*").alias("count")))
    totals = joint.groupBy(*keys).agg(F.sum("count").alias("total"))
    return joint.join(totals, keys).select(*keys, "value_b", "count", F.round(F.col("count") / F.col("total"), 4).alias("probability"))


def frequent_itemsets(df: DataFrame, basket: str, item: str, min_support: float) -> DataFrame:
    """``items, size, freq, baskets``: item sets in at least ``min_support`` of the baskets.

    A set is frequent only if each item is, so items below the threshold leave first.
    Supports of single items add up to the mean basket size, which bounds how many
    items remain; a basket's array can hold no more than those, however hot its key.
    """
    from pyspark.ml.fpm import FPGrowth

    pairs = (df.where(~missing(df, basket) & ~missing(df, item))
             .groupBy(F.col(f"`{basket}`").alias("basket"), as_text(df, item).alias("item")).agg(F.count("*")).select("basket", "item"))
    baskets = pairs.select("basket").distinct().agg(F.count("*").alias("n")).first()["n"]
    floor = min_support * baskets
    frequent = pairs.groupBy("item").agg(F.count("*").alias("c")).where(F.col("c") >= F.lit(floor)).select("item")
    # The miner reads its input several times.
    lists = saved(pairs.join(frequent, "item", "left_semi").groupBy("basket").agg(F.collect_list("item").alias("items")))
    kept = lists.count()
    # Half a basket below the threshold, so that rounding cannot lose a set; checked again below.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, floor - 0.5) / kept) if kept else 1.0).fit(lists)
    return model.freqItemsets.where(F.col("freq") >= F.lit(floor)).select(
        F.array_sort("items").alias("items"), F.size("items").alias("size"), "freq", F.lit(baskets).alias("baskets"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """``antecedent, consequent, confidence, lift, support`` from frequent item sets, one consequent each.

    Every part of a frequent set is frequent, so its frequency is among the sets.
    """
    sets = saved(itemsets)
    sides = sets.where(F.col("size") > 1).select("items", "freq", "baskets", F.explode("items").alias("consequent")).select(
        F.array_except("items", F.array("consequent")).alias("antecedent"), "consequent", "freq", "baskets")
    left = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("_left"))
    right = sets.where(F.col("size") == 1).select(F.col("items")[0].alias("consequent"), F.col("freq").alias("_right"))
    confidence = F.col("freq") / F.col("_left")
    return sides.join(left, "antecedent").join(right, "consequent").where(confidence >= min_confidence).select(
        "antecedent", "consequent", F.round(confidence, 4).alias("confidence"),
        F.round(confidence / (F.col("_right") / F.col("baskets")), 4).alias("lift"), F.round(F.col("freq") / F.col("baskets"), 6).alias("support"))
