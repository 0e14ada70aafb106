"""SimHash fingerprints and near duplicates by anchor-point covering.

The anchors are the words of a covering code: the product of two binary Golay codes, each
over 23 bits of a fingerprint, whose covering radius is 3 + 3 = 6. A fingerprint lies within 6
of its nearest anchor, its home. If two fingerprints differ in at most 2 bits, the second lies
within 6 + 2 = 8 of the home of the first. So every distinct fingerprint is replicated to all
anchors within 8 (about 76 of 16.8 million), and each anchor compares those at home there
with all that reached it. No link is missed, and the work grows with the distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridsight.functions.scale import saved
from gridsight.llm.batches import map_arrow, only
from gridsight.llm.components import components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
RADIUS = 6
# Fixed value: generator polynomial of the cyclic Golay code of length 23.
GOLAY = 0b110001110101
PART = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    count, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    joined = map(b" ".join, zip(*parts))
    for begin in range(0, count, PART):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for _, s in zip(range(PART), joined)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, bits)`` per document, ``bits`` as a signed 64-bit number. A null text has no words."""
    source = only(documents, key, text)

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["key", "bits"])

    return map_arrow(source, prints, f"key {source.schema['key'].dataType.simpleString()}, bits bigint").withColumnRenamed("key", key)


def _cosets(reach: int) -> tuple[np.ndarray, np.ndarray, list[dict[int, np.ndarray]]]:
    """Golay code tables: syndrome of each byte triple part, leader weight of a syndrome, and error words.

    The words of a coset by weight are as many for all cosets with equally heavy leaders
    (the code is perfect), so each table is rectangular: row of the syndrome, error words.
    """
    bit = np.zeros(23, np.int64)
    for place in range(23):
        value = 1 << place
        for top in range(22, 10, -1):
            if value >> top & 1:
                value ^= GOLAY << (top - 11)
        bit[place] = value
    words = np.arange(1 << 23)
    weight = np.bitwise_count(words)
    words, weight = words[weight <= reach], weight[weight <= reach]
    syndrome = np.zeros(len(words), np.int64)
    for place in range(23):
        syndrome ^= np.where(words >> place & 1, bit[place], 0)
    leader = np.full(2048, 9)
    np.minimum.at(leader, syndrome, weight)
    order = np.lexsort((words, weight, syndrome))
    words, weight, syndrome = words[order].astype(np.int32), weight[order], syndrome[order]
    row = np.zeros(2048, np.int64)
    tables = []
    for lead in range(4):
        own = np.flatnonzero(leader == lead)
        row[own] = np.arange(len(own))
        tables.append({w: words[(weight == w) & (leader[syndrome] == lead)].reshape(len(own), -1) for w in range(reach + 1)})
    return bit, np.stack([leader, row]), tables


def _syndromes(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    result = np.zeros(len(words), np.int64)
    for place in range(23):
        result ^= np.where(words >> place & 1, bit[place], 0)
    return result


def _anchor(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The number of an anchor: the top 12 bits of each code word tell it from all others."""
    return ((first >> 11).astype(np.int64) << 12 | second >> 11).astype(np.int32)


def anchors(bits: np.ndarray, tables, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home anchor of each fingerprint, and (index, anchor) pairs of all anchors within ``reach``."""
    bit, (leader, row), words = tables
    values = bits.view(np.uint64)
    halves = [(values >> np.uint64(s) & np.uint64((1 << 23) - 1)).astype(np.int64) for s in (0, 23)]
    syndromes = [_syndromes(h, bit) for h in halves]
    leads = [leader[s] for s in syndromes]
    home = np.zeros(len(bits), np.int32)
    indexes, found = [], []
    for kind in range(16):
        a, b = divmod(kind, 4)
        own = np.flatnonzero((leads[0] == a) & (leads[1] == b))
        if not len(own):
            continue
        rows = [row[s[own]] for s in syndromes]
        home[own] = _anchor(halves[0][own] ^ words[a][a][rows[0], 0], halves[1][own] ^ words[b][b][rows[1], 0])
        for weight in range(a, reach - b + 1):
            left = halves[0][own, None] ^ words[a][weight][rows[0]]
            right = np.concatenate([halves[1][own, None] ^ words[b][w][rows[1]] for w in range(b, reach - weight + 1)], axis=1)
            pair = _anchor(left[:, :, None], right[:, None, :]).reshape(len(own), -1)
            indexes.append(np.repeat(own, pair.shape[1]))
            found.append(pair.ravel())
    return home, np.concatenate(indexes), np.concatenate(found)


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``bits`` (a < b) that differ in 1 to ``threshold`` bits."""
    reach = RADIUS + threshold
    tables = prints.sparkSession.sparkContext.broadcast(_cosets(reach))

    def place(all_reached: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 2000):
                    bits = batch.column(0).slice(begin, 2000).to_numpy()
                    home, index, reached = anchors(bits, tables.value, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(reached), pa.array(bits[index])] if all_reached
                                                     else [pa.array(home), pa.array(bits)], ["anchor", "bits"])
        return run

    distinct = saved(prints.select("bits").filter("bits is not null").distinct())
    homes = distinct.mapInArrow(place(False), "anchor int, bits bigint").withColumnRenamed("bits", "a")
    copies = distinct.mapInArrow(place(True), "anchor int, bits bigint").withColumnRenamed("bits", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    # Spark takes the copies to be as small as the fingerprints that they are made from, so it would broadcast them.
    return homes.join(copies.hint("merge"), "anchor").filter((F.col("a") < F.col("b")) & close).select("a", "b")


def with_fingerprints(documents: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """All columns of each document and ``bits``, its fingerprint."""
    place = documents.columns.index(text)

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t or "", shingle) for t in batch.column(place).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.view(np.int64))], [*batch.schema.names, "bits"])

    return map_arrow(documents, prints, StructType([*documents.schema.fields, StructField("bits", LongType())]), column=place)


def groups(prints: DataFrame, key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """``(bits, component_id, root)`` per distinct fingerprint of the keyed rows ``(key, bits)``.

    ``root`` tells the groups apart; ``component_id``, a group's smallest key, may be shared where keys are repeated.
    """
    nodes = saved(prints.filter(F.col(key).isNotNull()).groupBy("bits").agg(F.min(key).alias("first")))
    roots = components(links(nodes, threshold)).select(F.col("node").alias("bits"), "component")
    rooted = saved(nodes.join(roots, "bits", "left").select("bits", "first", F.coalesce("component", "bits").alias("root")))
    least = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return saved(rooted.join(least, "root").select("bits", "component_id", "root"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    threshold: int = THRESHOLD) -> DataFrame:
    """``(key, bits, component_id)`` per document: the smallest key reachable over linked fingerprints.

    Equal fingerprints are one node, so copies are never paired. Both ends of a link have
    each other within reach, so pairs are looked for from the smaller one only. A row without key
    gets its fingerprint, links nothing and has no component; repeated keys and equal
    texts are separate rows; a text without words has fingerprint 0, linked as any other.
    """
    prints = saved(fingerprints(documents, key, text, shingle))
    classes = groups(prints, key, threshold)
    return prints.join(classes, "bits", "left").select(
        key, "bits", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))
