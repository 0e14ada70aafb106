"""Byte-level BPE: distinct words are encoded once, globally, and their ids joined back.

1. A task cuts its documents into pre-tokens, block by block (BLOCK_BYTES of text). A block is
   saved as one row: its distinct words and, per document, the numbers of its words in order.
2. The distinct words are shuffled by a hash of the word, in chunks: a row holds those words of a
   block that go to the same part. Each distinct word is encoded once, and its ids go back to the
   blocks that hold it.
3. A block's ids meet its positions and are put together in the order of the text.

A word is sent once per block that holds it, not once per occurrence, so a very common word
weighs no more than a rare one. Decoding joins ids with the table of token bytes,
whose size is that of the vocabulary and does not grow with the data.
"""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gridsight.functions.scale import shared_folder
from gridsight.llm.batches import lists, only

BLOCK_BYTES = 16_000_000
# Words whose ids a task remembers; beyond, it forgets them and may encode a word again.
KNOWN_WORDS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on every line. Read by the driver; a vocabulary is of fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of lowest rank, the first one among equals, until none is left.

    Pairs wait in a heap and parts are a linked list, so a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    end = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(size - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * size
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = end[left]
        if not alive[left] or right >= size or end[right] != stop:
            continue
        alive[right] = False
        end[left] = stop
        if stop < size:
            before[stop] = left
            pair = word[left:end[stop]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], left, end[stop]))
        if before[left] >= 0:
            pair = word[before[left]:stop]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], before[left], stop))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[word[at:end[at]]])
        at = end[at]
    return ids


def _pack(numbers: np.ndarray, rest: bytes = b"") -> bytes:
    """Whole numbers by bytes of equal weight, then other bytes, compressed."""
    numbers = numbers.astype("<u4")
    width = 4 if len(numbers) and numbers.max() >= 1 << 24 else 3 if len(numbers) and numbers.max() >= 1 << 16 else 2
    planes = numbers.view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
    head = np.array([len(numbers), width, len(rest)], "<i8").tobytes()
    return head + pa.compress(planes + rest, "zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    count, width, rest = np.frombuffer(packed[:24], "<i8").tolist()
    data = pa.decompress(packed[24:], count * width + rest, "zstd", asbytes=True)
    numbers = np.zeros((count, 4), np.uint8)
    numbers[:, :width] = np.frombuffer(data, np.uint8, count * width).reshape(width, count).T
    return numbers.view("<u4").ravel(), data[count * width:]


class _Block:
    """Documents of a task until they hold enough text."""

    def __init__(self):
        self.keys, self.lengths, self.positions, self.size, self.numbers = [], [], [], 0, {}

    def add(self, key, text: str, split: regex.Pattern) -> None:
        number = self.numbers.setdefault
        own = [number(w, len(self.numbers)) for w in split.findall(text)]
        self.keys.append(key)
        self.lengths.append(len(own))
        self.positions.append(np.array(own, np.uint32))
        self.size += len(text)

    def rows(self, kind: pa.DataType, parts: int) -> pa.RecordBatch:
        """One row: keys, words per document, the words' numbers, and the distinct words by part of their hash.

        Numbers go by falling frequency, as small numbers pack well.
        """
        flat = np.concatenate(self.positions)
        order = np.argsort(-np.bincount(flat, minlength=len(self.numbers)), kind="stable")
        renumber = np.empty(len(order), np.uint32)
        renumber[order] = np.arange(len(order), dtype=np.uint32)
        words = [w.encode() for w in self.numbers]
        part = np.array([zlib.crc32(w) % parts for w in words], np.int64)[order]
        by_part = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by_part], prepend=-1))
        chunks = []
        for begin, end in zip(cuts.tolist(), [*cuts.tolist()[1:], len(by_part)]):
            numbers = by_part[begin:end]
            own = [words[i] for i in order[numbers].tolist()]
            chunks.append({"part": int(part[numbers[0]]), "numbers": _pack(np.diff(numbers, prepend=0)), "words": _pack(np.array([len(w) for w in own]), b"".join(own))})
        return pa.RecordBatch.from_arrays(
            [lists(pa.array(self.keys, kind), [len(self.keys)], kind), pa.array([_pack(np.array(self.lengths))]),
             pa.array([_pack(renumber[flat] if len(flat) else flat)]),
             pa.array([chunks], pa.list_(pa.struct([("part", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary())])))],
            ["keys", "lengths", "positions", "chunks"])


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    """Rows saved to the shared folder in buckets of a key that later meets them: they are not shuffled again."""
    spark = rows.sparkSession
    name = f"gridsight_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/gridsight/{name}").saveAsTable(name)
    return spark.table(name)


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
           block_bytes: int = BLOCK_BYTES, decoded: str | None = None) -> DataFrame:
    """``(key, n_tokens, ids)`` per document; ``ids`` are packed as little-endian 32-bit numbers.

    With ``decoded``, a column of that name holds what ``decode`` makes of the ids, in the same task.

    Every match of ``pattern`` is encoded by itself, without special tokens, and what no match
    covers is left out, as in the library of that file format. Null and empty texts have
    no ids; null and repeated keys are separate rows; other columns are ignored. One text is part
    of one block, however long.
    """
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    tokens = spark.sparkContext.broadcast(_token_table(ranks))
    source = only(documents, key, text)
    kind = source.schema["key"].dataType.simpleString()
    parts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block, arrow = regex.compile(pattern), _Block(), None
        for batch in batches:
            arrow = batch.column(0).type
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(name, value.as_py(), split)
                if block.size >= block_bytes:
                    yield block.rows(arrow, parts)
                    block = _Block()
        if block.keys:
            yield block.rows(arrow, parts)

    blocks = _bucketed(source.mapInArrow(cut, f"keys array<{kind}>, lengths binary, positions binary, chunks array<struct<part:int,numbers:binary,words:binary>>")
                   .withColumn("block", F.monotonically_increasing_id()), "block")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            found = []
            for packed in batch.column(2).to_pylist():
                sizes, data = _unpack(packed)
                ids, counts, begin = [], [], 0
                for size in sizes.tolist():
                    word = data[begin:begin + size]
                    begin += size
                    own = known.get(word)
                    if own is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        own = known[word] = tuple(merge(word, table.value))
                    ids += own
                    counts.append(len(own))
                found.append((_pack(np.array(counts)), _pack(np.array(ids))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*found))],
                                             ["block", "numbers", "counts", "ids"])

    words = (blocks.select("block", F.explode("chunks").alias("c")).select("block", "c.numbers", "c.words", "c.part").repartition("part")
             .select("block", "numbers", "words").mapInArrow(encoded, "block bigint, numbers binary, counts binary, ids binary"))

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, totals, packed, texts = [], [], [], []
        for row in left.to_pylist():
            numbers, counts, ids = ([_unpack(v)[0] for v in right.column(c).to_pylist()] for c in ("numbers", "counts", "ids"))
            number = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(n, dtype=np.int64) for n in numbers)]).astype(np.int64)
            count = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
            flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype("<u4")
            starts, sizes = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
            starts[number], sizes[number] = np.cumsum(count) - count, count
            positions, begin = _unpack(row["positions"])[0], 0
            for name, length in zip(row["keys"], _unpack(row["lengths"])[0].tolist()):
                own = positions[begin:begin + length]
                begin += length
                size = sizes[own]
                total = int(size.sum())
                place = np.arange(total) + np.repeat(starts[own] - (np.cumsum(size) - size), size)
                keys.append(name)
                totals.append(total)
                packed.append(flat[place].tobytes())
                if decoded:
                    texts.append(_bytes_of(packed[-1], tokens.value))
        pa.default_memory_pool().release_unused()
        columns = [pa.array(keys, left.schema.field("keys").type.value_type), pa.array(totals, pa.int64()), pa.array(packed, pa.binary())]
        return pa.table([*columns, *([pa.array(texts, pa.binary())] if decoded else [])], names=["key", "n_tokens", "ids", *([decoded] if decoded else [])])

    return (blocks.select("block", "keys", "lengths", "positions").groupBy("block").cogroup(words.groupBy("block"))
            .applyInArrow(assemble, f"key {kind}, n_tokens bigint, ids binary" + (f", `{decoded}` binary" if decoded else "")).withColumnRenamed("key", key))


def _token_table(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks.items()}


def _bytes_of(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes that packed ``ids`` stand for: each id meets its row of the token table. Null ids stay null.

    The table is broadcast: it has a row per token of the vocabulary, whatever the data. An id
    without a token raises an error.
    """
    table = encoded.sparkSession.sparkContext.broadcast(_token_table(ranks))
    schema = encoded.drop(name).withColumn(name, F.lit(b"")).schema
    columns = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            texts = [None if i is None else _bytes_of(i, table.value) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.binary())], [*columns, name])

    return encoded.select(*columns).mapInArrow(run, schema)
