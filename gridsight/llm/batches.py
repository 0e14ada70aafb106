"""Arrow batches of texts as flat byte arrays, and words as positions in them.

All helpers work on one slice of an Arrow batch (PIECE_BYTES of text, or one longer row)
and keep nothing between slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Bytes of text that one call of a function works on.
PIECE_BYTES = 3_000_000

# Bytes of a word after A-Z are lower-cased: digits, a-z, and every byte of a character beyond ASCII.
_BYTES = np.arange(256)
ALNUM_BYTES = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER_BYTES = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def only(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text alone, so that other columns never reach Python; a null text is empty."""
    return df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``limit`` bytes of text in one column, or one longer row."""
    ends = text_bytes(batch.column(column))[1][1:]
    begin = done = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin, done = end, int(ends[end - 1])


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, limit: int = PIECE_BYTES,
              column: int = 1) -> DataFrame:
    """Apply a function to slices by the size of one text column, so that its memory does not depend on how Spark cuts batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit, column):
                yield function(piece)
            pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the n + 1 places where they begin and end."""
    column = pc.fill_null(column, "")
    _, starts, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(starts, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    joined = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return joined, offsets - offsets[0]


class Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts whose A-Z are lower-cased, or runs of other bytes that are ``inside``.

    Characters beyond ASCII are word characters, and so are all bytes that encode
    them, which makes splitting the bytes the same as splitting the characters.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray = ALNUM_BYTES):
        joined, offsets = text_bytes(column)
        self.low = LOWER_BYTES[joined]
        self.inside = inside[self.low]
        before = np.zeros(len(joined), bool)
        before[1:] = self.inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(joined)]] = False
        after = np.zeros(len(joined), bool)
        after[:-1] = self.inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        # first[i] is the number of the first word of text i.
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of every word, the same in every batch."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        begins = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begins, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        mixed = _MIX[self.low[self.inside]] * powers[place]
        sums = np.add.reduceat(mixed, begins)
        sums ^= sums >> np.uint64(29)
        sums *= np.uint64(0xBF58476D1CE4E5B9)
        return sums ^ (sums >> np.uint64(32))

    def word(self, index: int) -> bytes:
        return self.low[self.starts[index]:self.ends[index]].tobytes()


_MIX = np.random.default_rng(20).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many ranges, overlapping or not, one after another, and the n + 1 places where they begin and end."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts, dtype=np.int64)])
    return data[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])], offsets


def texts(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.large_string()) -> pa.Array:
    """A text column over bytes and the places where its texts begin and end."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def lists(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
