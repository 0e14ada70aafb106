"""Size checks, lineage cuts and distributed numbering.

Every operator has one form, the distributed one, whatever the size of its input.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_SAVED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where a session names none, a temporary one is set if all tasks run in this process; on a
    cluster each executor would write to a disk of its own, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridsight-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them back.

    Unlike an eager checkpoint this computes the rows once, keeps them columnar, and
    leaves the optimizer with their true size. It survives the loss of executors. ``drop_saved``
    removes these tables once no result is read from them any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridsight/{uuid.uuid4().hex}"
    _SAVED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_at(path: str) -> str:
    """Have ``drop_saved`` remove a folder that is written by other means."""
    if path not in _SAVED:
        _SAVED.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder in the file system of a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def drop_saved(spark: SparkSession) -> int:
    """Remove the tables and fits that were saved so far; how many there were. Frames that read them end with it."""
    count = len(_SAVED)
    while _SAVED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an iterative fit over a scan of few splits.

    Only a plan without a shuffle is looked at (asking it for its splits costs no job);
    a table of more splits than cores, any large one, is left as it is.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)


BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has few enough rows and bytes, else as it is.

    Meant for saved frames or cheap aggregates: it measures up to ``rows + 1`` rows.
    """
    size = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= rows and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def row_numbers(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in a total order over the whole frame.

    The frame is range-sorted once and saved, so that the partition a row
    is in cannot change; a row's number is its place in the partition plus the rows in
    the partitions before it. Only one count per partition reaches the driver.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    ordered = saved(df.orderBy(*order).withColumn("_part", part).withColumn("_within", within))
    counts = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}
    starts, total = [], 0
    for index in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(index, 0)
    offsets = F.array(*[F.lit(s) for s in starts or [0]]).cast("array<bigint>")
    place = F.element_at(offsets, (F.col("_part") + 1).cast("int")) + F.col("_within") + 1
    return ordered.withColumn(name, place).drop("_part", "_within")


def row_digest(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two independent 64-bit hashes of a row, nulls told apart from absent values.

    Grouping by them finds equal rows while shuffling 16 bytes a row instead of the
    row itself; two different rows agree on both with probability about n^2 / 2^129.
    """
    columns = columns or df.columns
    parts: list[Column] = []
    for c in columns:
        value = F.col(f"`{c}`")
        parts += [value, value.isNull()]
    return [F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("_h2")]


def row_copies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per distinct row digest with its ``copies``."""
    return df.select(*row_digest(df, columns)).groupBy("_h1", "_h2").agg(F.count("*").alias("copies"))


def running_totals(df: DataFrame, keys: list[str], order: str, weight: str, name: str) -> DataFrame:
    """Adds the running sum of ``weight`` in the order of a column, within ``keys``.

    The rows must be distinct in ``keys`` and ``order`` (already counted). The frame
    is range-sorted over keys and order together and saved; each part sums its
    own rows and adds the totals of the parts before it, so no key needs one task.
    """
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    ordered = saved(df.orderBy(*keys, order).withColumn("_part", part))
    sums = {r["_part"]: r["s"] for r in ordered.groupBy("_part").agg(F.sum(weight).alias("s")).collect()}
    starts, total = [], 0
    for index in range(max(sums, default=-1) + 1):
        starts.append(total)
        total += sums.get(index, 0)
    before = F.element_at(F.array(*[F.lit(s) for s in starts or [0]]).cast("array<bigint>"), (F.col("_part") + 1).cast("int"))
    inside = W.partitionBy("_part").orderBy(*keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    overall = ordered.withColumn(name, before + F.sum(weight).over(inside)).drop("_part")
    if not keys:
        return overall
    # A key's own start is its smallest running sum less that row's weight.
    begins = overall.groupBy(*keys).agg(F.min(F.col(name) - F.col(weight)).alias("_begin"))
    return overall.join(broadcast_checked(begins), keys).withColumn(name, F.col(name) - F.col("_begin")).drop("_begin")


#: A key with more than one in so many of the whole weight is hot; so there are fewer than this many hot keys.
HOT_SHARE = 1000


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str], weight: str, share: int = HOT_SHARE) -> DataFrame:
    """Rows with the columns of the ``totals`` row of their keys, where a key may hold a large share of the rows.

    ``totals`` has a row per key, and ``weight``, a column of it that is not negative and grows with the rows of a key. Hot keys are
    broadcast, fewer than ``share`` of them by construction; the others meet in a shuffle, where none is large. Rows
    whose keys are null or not in ``totals`` are left out.
    """
    whole = totals.agg(F.sum(F.col(weight).cast("decimal(38,0)"))).scalar()
    heavy = F.col(weight).cast("decimal(38,0)") * share > whole
    cold = rows.join(F.broadcast(totals.filter(heavy).select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(totals.filter(heavy)), keys).unionByName(cold.join(totals.filter(~heavy), keys))
