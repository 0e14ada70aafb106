"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Pieces are sentences (or PIECE characters of a longer one), a paragraph is a line, and a section is a
run of paragraphs that ends where a paragraph's own hash says so, so that an edit moves no later
section. Roots are equal for equal texts only; where two trees differ, the branches that
have no counterpart locate the edits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

PIECE = 160
SECTION = 4
CELLS = 1 << 16
_LINES = re.compile(r"[^\n]*\n|[^\n]+")
_PIECES = re.compile(r"[^.!?]{1,%d}[.!?]*\s*|[.!?]+\s*" % PIECE)


def _hash(kind: bytes, data: bytes) -> bytes:
    return blake2b(data, digest_size=16, person=kind).digest()


def tree(text: str) -> tuple:
    """A node is ``(hash, length in characters, children)``; the root's children are sections, a piece has none."""
    sections, open_section = [], []
    for line in _LINES.findall(text):
        pieces = tuple((_hash(b"piece", p.encode("utf-8", "surrogatepass")), len(p), ()) for p in _PIECES.findall(line))
        open_section.append(_node(b"paragraph", pieces))
        if open_section[-1][0][0] % SECTION == 0:
            sections.append(_node(b"section", tuple(open_section)))
            open_section = []
    if open_section:
        sections.append(_node(b"section", tuple(open_section)))
    return _node(b"root", tuple(sections))


def _node(kind: bytes, children: tuple) -> tuple:
    return _hash(kind, b"".join(c[0] for c in children)), sum(c[1] for c in children), children


def _unmatched(left: list, right: list) -> tuple[int, list, list]:
    """Characters of equal nodes on both sides, and the nodes without counterpart."""
    spare = Counter(n[0] for n in right)
    common, rest, matched = 0, [], Counter()
    for node in left:
        if spare[node[0]] > matched[node[0]]:
            matched[node[0]] += 1
            common += node[1]
        else:
            rest.append(node)
    others = []
    for node in right:
        if matched[node[0]] > 0:
            matched[node[0]] -= 1
        else:
            others.append(node)
    return common, rest, others


def likeness(left: tuple, right: tuple) -> float:
    """Twice the characters under equal branches by those of both texts; 1 for equal roots only.

    Equal sections count whole; only the children of the others are compared, level by level.
    """
    if left[0] == right[0]:
        return 1.0
    common, a, b = 0, list(left[2]), list(right[2])
    while a and b:
        same, a, b = _unmatched(a, b)
        common += same
        a, b = [c for n in a for c in n[2]], [c for n in b for c in n[2]]
    return min(2 * common / max(1, left[1] + right[1]), 1 - 1e-9)


def edits(left: tuple, right: tuple) -> list[tuple[int, int]]:
    """Runs of characters of the left text in pieces that have no counterpart on the right: the differing branches."""
    def walk(nodes: list, others: list, at: dict) -> list:
        _, rest, spare = _unmatched(nodes, others)
        if not rest:
            return []
        if not rest[0][2]:
            return [(at[id(n)], at[id(n)] + n[1]) for n in rest]
        below, places = [], {}
        for node in rest:
            begin = at[id(node)]
            for child in node[2]:
                places[id(child)] = begin
                below.append(child)
                begin += child[1]
        return walk(below, [c for n in spare for c in n[2]], places)

    if left[0] == right[0]:
        return []
    begin, places = 0, {}
    for node in left[2]:
        places[id(node)] = begin
        begin += node[1]
    runs: list[tuple[int, int]] = []
    for first, last in sorted(walk(list(left[2]), list(right[2]), places)):
        if runs and runs[-1][1] == first:
            runs[-1] = (runs[-1][0], last)
        else:
            runs.append((first, last))
    return runs


def compare(rows: DataFrame, text: str, others: list[str]) -> DataFrame:
    """Add ``<text>_root`` and, for each other text column, ``<other>_root``, ``<other>_likeness`` and ``<other>_edits``.

    Null texts are empty; an empty text has a root of its own and is like itself only.
    """
    columns = list(rows.columns)
    schema = rows.withColumn(f"{text}_root", F.lit(""))
    for other in others:
        schema = schema.withColumns({f"{other}_root": F.lit(""), f"{other}_likeness": F.lit(0.0),
                                     f"{other}_edits": F.lit(None).cast("array<struct<first:bigint,last:bigint>>")})
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [tree(t or "") for t in batch.column(columns.index(text)).to_pylist()]
            arrays, names = [*batch.columns, pa.array([t[0].hex() for t in own], pa.string())], [*columns, f"{text}_root"]
            for other in others:
                roots, near, places = [], [], []
                for left, value in zip(own, batch.column(columns.index(other)).to_pylist()):
                    right = tree(value or "")
                    roots.append(right[0].hex())
                    near.append(likeness(left, right))
                    places.append([{"first": a, "last": b} for a, b in edits(left, right)])
                arrays += [pa.array(roots, pa.string()), pa.array(near, pa.float64()), pa.array(places, span)]
                names += [f"{other}_root", f"{other}_likeness", f"{other}_edits"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(_small(run), schema.schema)


def _small(run):
    """Trees of 500 texts at a time are in memory."""
    def cut(batches):
        yield from run(b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500))
    return cut


def following(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, next_text)``: the text of the next row by key, after the last the first.

    Rows are dealt into ranges of keys by a histogram of at most CELLS counts; the first row of
    each range also goes to the range before, so texts are shuffled once and no order is global. Keys are
    whole numbers; equal keys follow each other by text. Rows without key have no place in the order, and an empty next text.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ids = documents.select(F.col(f"`{key}`").cast("bigint").alias("key")).filter("key is not null")
    low, high, count = ids.agg(F.min("key"), F.max("key"), F.count("*")).first()
    alone = rows.filter("key is null").withColumn("next_text", F.lit(""))
    if not count:
        return alone.withColumnRenamed("key", key)
    cell = F.least(F.lit(CELLS - 1), F.floor((F.col("key").cast("double") - float(low)) / (float(high) - float(low) + 1) * CELLS)).cast("int")
    sizes = sorted((r["cell"], r["count"], r["first"]) for r in
                   ids.groupBy(cell.alias("cell")).agg(F.count("*").alias("count"), F.min("key").alias("first")).collect())
    parts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part_of, firsts, done = [0] * CELLS, {}, 0
    for place, size, first in sizes:
        part_of[place] = done * parts // count
        firsts.setdefault(part_of[place], first)
        done += size
    used = sorted(firsts)
    before = {part: used[i - 1] for i, part in enumerate(used)}
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    first_of, part_before = numbers([firsts.get(p, 0) for p in range(parts)]), numbers([before.get(p, 0) for p in range(parts)])
    placed = rows.filter("key is not null").withColumn("part", F.element_at(numbers(part_of), cell + 1).cast("int"))
    borrowed = F.col("key") == F.element_at(first_of, F.col("part") + 1)
    copies = F.filter(F.array(F.struct("part", F.lit(0).alias("late")),
                              F.struct(F.element_at(part_before, F.col("part") + 1).cast("int").alias("part"), F.lit(1).alias("late"))),
                      lambda c: (c["late"] == 0) | borrowed)
    dealt = placed.select("key", "text", F.explode(copies).alias("c")).select("key", "text", "c.part", "c.late")
    order = W.partitionBy("part").orderBy("late", "key", "text")
    found = dealt.withColumn("next_text", F.lead("text").over(order)).filter("late = 0").select("key", "text", "next_text")
    return found.unionByName(alone).withColumnRenamed("key", key)
