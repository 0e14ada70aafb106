"""A dataset catalog as table operators: fingerprints, duplicates, versions, references."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridsight.functions.parsing import as_text, missing
from gridsight.functions.scale import row_numbers, saved


#: Files of up to so many bytes are read whole by Spark's reader, larger ones in pieces.
WHOLE, PIECE = 16 << 20, 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a file as Arrow opens it, and the file's name there."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), f"/{rest.lstrip('/')}"
    authority, _, name = rest.removeprefix("//").partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{name}"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the files of the first column, in place of the last; a task holds a piece of a file at a time."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            store, name = _opened(path)
            digest = hashlib.sha256()
            with store.open_input_stream(name) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=batch.schema.names)


def _streamed_by_driver(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file in a store that only Spark opens."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sink = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place), sink, PIECE, True)
    return digest.digest().hex()


def file_fingerprints(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SHA-256 of each file's bytes under a path, with size and time.

    A file of any size is hashed by one task, in pieces. Where Arrow cannot open the store, the driver streams the files over WHOLE
    bytes; tasks hash the others in either case.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files, facts = reader.load(path), [F.col("path"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at")]
    small = files.where(F.col("length") <= WHOLE).select(*facts, F.sha2("content", 256).alias("fingerprint"))
    large = files.where(F.col("length") > WHOLE).select(*facts, F.lit(None).cast("string").alias("fingerprint"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        _opened(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())
    except (OSError, pa.ArrowException):
        rows = [(*r[:3], _streamed_by_driver(spark, r["path"])) for r in large.collect()]
        return small.unionByName(spark.createDataFrame(rows, large.schema))
    return small.unionByName(large.mapInArrow(_streamed, large.schema))


def row_fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's cells; a missing cell differs from an empty one, and lengths
    keep neighbouring cells apart."""
    parts = []
    for c in columns or df.columns:
        text = as_text(df, c)
        parts.append(F.when(missing(df, c), "-1:").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a fingerprint of the table's rows, in any order, and their number.

    The sum of the row hashes (as big decimals) does not depend on row order and, unlike
    an exclusive or, does not cancel repeated rows.
    """
    digest = row_fingerprint(df)
    half = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(28,0)")
    sums = df.select(*[half(1 + 15 * i).alias(f"h{i}") for i in range(4)]).agg(
        *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)], F.count("*").alias("row_count"))
    joined = F.concat_ws("|", *[F.coalesce(F.col(f"h{i}").cast("string"), F.lit("0")) for i in range(4)], F.col("row_count").cast("string"))
    return sums.select(F.sha2(joined, 256).alias("fingerprint"), "row_count")


def exact_duplicates(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows whose content equals an earlier row's: ``key, first_key, fingerprint, copies``.

    Contents are compared by SHA-256; per fingerprint the first key and the number of
    copies are aggregated before the join, so a hot group is one row on that side.
    """
    marked = df.select(F.col(f"`{key}`").alias("key"), row_fingerprint(df, content).alias("fingerprint"))
    groups = marked.groupBy("fingerprint").agg(F.min("key").alias("first_key"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    return marked.join(groups, "fingerprint").where(F.col("key") != F.col("first_key"))


def known_content(df: DataFrame, catalog: DataFrame, fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Rows whose fingerprint is in the catalog, and rows whose is not."""
    known = catalog.select(fingerprint).where(F.col(fingerprint).isNotNull()).distinct()
    return df.join(known, fingerprint, "left_semi"), df.join(known, fingerprint, "left_anti")


def version_chain(uploads: DataFrame, name: str, uploaded_at: str, fingerprint: str, tie: str | None = None) -> DataFrame:
    """Versions per file name: new content gets the next number and knows its predecessor.

    Content already seen under any name is no new version. Firsts are numbered over all names at
    once, and a name's versions count from its own first number, so no name needs one task.
    """
    order = [F.col(uploaded_at)] + ([F.col(tie)] if tie else [])
    moment = F.struct(*order, F.col(name)).alias("m")
    firsts = uploads.groupBy(fingerprint).agg(F.min(moment).alias("m")).select(
        F.col(fingerprint), F.col(f"m.{name}").alias(name), F.col(f"m.{uploaded_at}").alias(uploaded_at), *([F.col(f"m.{tie}").alias(tie)] if tie else []))
    columns = firsts.columns
    place = [F.col(c) for c in (name, uploaded_at, *([tie] if tie else []), fingerprint)]
    numbered = saved(row_numbers(firsts, place, "_place"))
    begins = saved(numbered.groupBy(name).agg(F.min("_place").alias("_begin")))
    before = numbered.select((F.col("_place") + 1).alias("_place"), F.col(name).alias("_name"), F.col(fingerprint).alias("previous_fingerprint"))
    joined = numbered.join(begins, numbered[name].eqNullSafe(begins[name])).select(*[numbered[c] for c in columns], "_place", "_begin").join(before, "_place", "left")
    return joined.select(*columns, (F.col("_place") - F.col("_begin") + 1).cast("int").alias("version"),
                         F.when(F.col(name).eqNullSafe(F.col("_name")), F.col("previous_fingerprint")).alias("previous_fingerprint"))


def reference_counts(masters: DataFrame, copies: DataFrame, fingerprint: str, deleted: str, uploaded_at: str) -> DataFrame:
    """Active copies per master and the latest time any copy referred to it."""
    counts = copies.groupBy(fingerprint).agg(F.count_if(~F.col(deleted)).alias("reference_count"), F.max(uploaded_at).alias("last_referenced_at"))
    return masters.select(fingerprint).join(counts, fingerprint, "left").select(
        fingerprint, F.coalesce("reference_count", F.lit(0)).alias("reference_count"), "last_referenced_at")


def removable_masters(masters: DataFrame, copies: DataFrame, fingerprint: str, deleted: str) -> DataFrame:
    """Masters that no active copy refers to."""
    active = copies.where(~F.col(deleted)).select(fingerprint).distinct()
    return masters.join(active, fingerprint, "left_anti")


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, written_at: str) -> DataFrame:
    """The next snapshot: per key the row written last, a change winning a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(written_at), F.col("_new"))).alias("r")
    return both.groupBy(key).agg(newest).select(key, "r.*")


def newest_first(catalog: DataFrame, uploaded_at: str, tie: str, limit: int | None = 100) -> DataFrame:
    """The catalog's latest entries: a top-k list, or all of them for ``None``."""
    ordered = catalog.orderBy(F.desc(uploaded_at), F.asc(tie))
    return ordered if limit is None else ordered.limit(limit)
