"""Vector codes: product quantisation with integer codebooks, searched by equal averages.

A vector is cut into equal consecutive parts and each part becomes the number of its nearest codebook entry. The entries
of a codebook are sorted by the sum of their components; a search begins at the part's own sum and expands outward. As
(a sum's gap)^2 / dimension is never more than the squared distance, it ends once that bound strictly exceeds
the best distance. All arithmetic is in integers.

Spark holds the rows; the driver sees codebooks and their sums alone, PARTS x ENTRIES rows a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridsight.functions.scale import saved, spread
from gridsight.llm.batches import lists
from gridsight.llm.lookups import with_totals

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Largest component times the width of a part, so that no product in a search passes 63 bits.
LARGEST = 1 << 30


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest of ``entries`` for each row of ``parts``, ties to the lower one, and its squared distance."""
    count, width = parts.shape
    order = np.argsort(entries.sum(axis=1), kind="stable")
    ranked = entries[order]
    sums, own = ranked.sum(axis=1), parts.sum(axis=1)
    best, found = np.full(count, (1 << 62) // max(1, width)), np.zeros(count, np.int64)
    # The next entry to look at on each side; a side that has ended is farther than any sum.
    high = np.searchsorted(sums, own)
    low = high - 1
    ended = 1 << 31
    rows = np.arange(count)
    while len(rows):
        above = np.where(high[rows] < len(sums), sums[np.minimum(high[rows], len(sums) - 1)] - own[rows], ended)
        below = np.where(low[rows] >= 0, own[rows] - sums[np.maximum(low[rows], 0)], ended)
        up, gap = above < below, np.minimum(above, below)
        going = (gap < ended) & (gap * gap <= best[rows] * width)
        rows, up = rows[going], up[going]
        at = np.where(up, high[rows], low[rows])
        high[rows] += up
        low[rows] -= ~up
        gaps = parts[rows] - ranked[at]
        distance, entry = (gaps * gaps).sum(axis=1), order[at]
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < found[rows]))
        best[rows[better]], found[rows[better]] = distance[better], entry[better]
    return found, best


def _parts(column: pa.Array, count: int) -> np.ndarray:
    """Parts of a batch of vectors: part, row, component."""
    flat = column.flatten().to_numpy().astype(np.int64)
    return flat.reshape(len(column), count, len(flat) // max(1, len(column) * count)).transpose(1, 0, 2)


def learn(vectors: DataFrame, seeds: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, component]`` after some rounds from ``seeds``, over all rows of ``v``."""
    books = seeds
    count, entries, width = books.shape

    def round_of(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The sums of each entry's parts, and in the last place how many they are.
            totals = np.zeros((count, entries, width + 1), np.int64)
            for batch in batches:
                for part, rows in enumerate(_parts(batch.column(0), count)):
                    found, _ = nearest(rows, books[part])
                    used, starts, sizes = np.unique(np.sort(found), return_index=True, return_counts=True)
                    totals[part, used, :width] += np.add.reduceat(rows[np.argsort(found, kind="stable")], starts, axis=0)
                    totals[part, used, width] += sizes
            places = np.flatnonzero(totals.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(totals.reshape(-1)[places])], ["place", "total"])
        return run

    for _ in range(rounds):
        sums = np.zeros(count * entries * (width + 1), np.int64)
        for row in vectors.select("v").mapInArrow(round_of(books), "place bigint, total bigint").groupBy("place").agg(F.sum("total").alias("total")).collect():
            sums[row["place"]] = row["total"]
        sums = sums.reshape(count, entries, width + 1)
        used = sums[..., -1:]
        books = np.where(used > 0, sums[..., :-1] // np.maximum(used, 1), books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``key, label, code, error`` of each row of ``key, label, v``."""
    schema = vectors.select("key", "label").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(books)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for part, rows in enumerate(_parts(batch.column(2), len(books))):
                codes[:, part], distance = nearest(rows, books[part])
                errors += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)],
                                             ["key", "label", "code", "error"])

    return vectors.select("key", "label", "v").mapInArrow(run, schema)


def whole_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, label, v`` of the rows whose vector and components are neither null nor infinite nor NaN; ``v`` is floor(SCALE x)."""
    x = F.col(f"`{vector}`")
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    # Numbers beyond the range are written as LARGEST, which no width allows.
    small = lambda c: F.when(F.abs(c) * SCALE < LARGEST, F.floor(c.cast("double") * SCALE)).otherwise(LARGEST).cast("int")
    return table.filter(x.isNotNull() & F.forall(x, real)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.transform(x, small).alias("v"))


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """``key, label, code, error, label_error, codebooks_sha256`` per row with a whole vector.

    Codebooks begin as the vectors with the smallest keys (null keys last, equal keys by vector) and learn from all rows. A
    codebook has fewer entries where there are fewer rows. ``code`` has two hex digits a part, ``error`` is the
    squared distance to the entries, ``label_error`` its sum over the rows of equal label (nulls are equal).

    Null vectors and such with a null, infinite or NaN component are dropped, repeated rows are coded each, other columns are
    not read, and a table without whole vectors gives no rows. Vectors of unequal lengths, of a length that
    ``parts`` does not divide, and components too large for exact 64-bit distances are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    vectors = saved(spread(whole_vectors(table, key, vector, label)))
    facts = vectors.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"),
                        F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("largest")).first()
    length = facts["high"] or 0
    if facts["low"] != facts["high"] or length % parts:
        raise ValueError(f"vectors of {facts['low']} to {length} components cannot be cut into {parts} equal parts")
    if (facts["largest"] or 0) * (length // parts) >= LARGEST:
        raise ValueError("components are too large for exact distances")
    first = vectors.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(entries).collect()
    seeds = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    books = learn(vectors, seeds, rounds) if first else seeds
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = saved(encode(vectors, books).withColumn("_label", F.to_json(F.struct("label"))))
    sums = saved(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")))
    found = with_totals(coded, sums, ["_label"], "_rows")
    return found.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
