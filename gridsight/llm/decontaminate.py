"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of SHARD_BYTES of the documents a task reads. Its words become numbers (0 for words that no test
phrase has), an FM-index is built over them, every test phrase is searched backwards, its
occurrences are located and the words they cover are merged into removal spans. Documents
are never shuffled. The benchmark travels in blocks of BLOCK_BYTES of text, so its size is
bounded in every task; a larger benchmark means more blocks, each searched in every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridsight.llm.batches import Words, lists, map_arrow, only
from gridsight.llm.fmindex import FMIndex

WINDOW = 10
BLOCK_BYTES = 1_000_000
SHARD_BYTES = 3_000_000

FOUND = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "spans": "array<struct<first:bigint,last:bigint>>"}


class Phrases:
    """Windows of a block of benchmark items, as numbers of the block's own words."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.string()))
        hashes = words.hashes()
        self.hashes, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = [b""] + [words.word(i) for i in first]
        rows, lengths, items = [], [], []
        for index in range(len(texts)):
            own = number[words.first[index]:words.first[index + 1]] + 1
            size = min(window, len(own))
            if size:
                parts = np.lib.stride_tricks.sliding_window_view(own, size)
                rows.append(np.pad(parts, ((0, 0), (0, window - size))))
                lengths += [size] * len(parts)
                items += [index] * len(parts)
        table = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.phrases, of = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        self.lengths = (self.phrases != 0).sum(axis=1)
        # All items that share a window, for each distinct window.
        pairs = np.unique(np.stack([of.ravel(), np.array(items, np.int64)], axis=1), axis=0) if len(table) else np.zeros((0, 2), np.int64)
        self.owners = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(self.phrases))))
        self.ids = ids

    @classmethod
    def of(cls, state: dict) -> "Phrases":
        """From the plain fields that a broadcast carries."""
        self = cls.__new__(cls)
        self.__dict__.update(state)
        return self

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hashed word, 0 where no phrase has it."""
        kind = np.uint16 if len(self.words) <= 1 << 16 else np.uint32
        if not len(self.hashes):
            return np.zeros(len(hashes), kind)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(kind)


def phrase_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Benchmark rows in blocks of bounded size, one block in the driver at a time."""
    ids, texts, size = [], [], 0
    for row in only(benchmark, item, text).withColumnRenamed("key", "item").selectExpr("cast(item as string) item", "text").toLocalIterator():
        if size and size + len(row["text"]) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item"])
        texts.append(row["text"])
        size += len(row["text"])
    if texts:
        yield ids, texts


def _search(words: Words, hashes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: number of the first word, length, number of the phrase."""
    numbers, docs = phrases.numbers(hashes), len(words.first) - 1
    # A 0 stands before every document and at the end.
    text = np.zeros(len(words) + docs + 1, numbers.dtype)
    text[np.arange(len(words)) + np.repeat(np.arange(1, docs + 1), words.counts())] = numbers
    index = FMIndex(text, len(phrases.words))
    low, high = index.search(phrases.phrases, phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = index.locate(rows)
    # Positions in the text back to words: as many zeros stand before as documents have begun.
    zeros = np.searchsorted(words.first[:-1] + np.arange(docs), at, side="right")
    return at - zeros, phrases.lengths[which], which


def find_passages(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Words of documents inside an occurrence of ``window`` consecutive benchmark words.

    Returns a row per document: its key (all its columns if ``carry``), ``n_words``, ``n_hit``, ``items`` (sorted ids, as
    text, of the items with occurring windows) and merged ``spans`` of word numbers, last one
    excluded. An item of fewer words is one window; one without words has none. Null texts are
    empty; documents with equal or null keys are separate rows; an item without id hits but is
    in no list; carried columns named as the new ones are replaced. Empty tables give no rows or no hits.
    """
    spark = documents.sparkSession
    blocks = [spark.sparkContext.broadcast(vars(Phrases(ids, texts, window))) for ids, texts in phrase_blocks(benchmark, item, item_text, block_bytes)]
    kept = [c for c in documents.columns if c not in FOUND] if carry else [key]
    source = documents.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = source.drop("_text").withColumns({name: F.lit(None).cast(kind) for name, kind in FOUND.items()}).schema

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(len(kept)))
        hashes = words.hashes()
        docs = batch.num_rows
        cover = np.zeros(len(words) + 1, np.int64)
        doc_items: list[set] = [set() for _ in range(docs)]
        for block in blocks:
            phrases = Phrases.of(block.value)
            if not len(phrases.phrases):
                continue
            at, length, which = _search(words, hashes, phrases)
            if len(at):
                # Equal hashes almost always mean equal words; the words themselves decide.
                spans, back = np.unique(at * (window + 1) + length, return_inverse=True)
                same = np.ones(len(at), bool)
                wrong = {int(i) for i in _covered(spans // (window + 1), spans % (window + 1))
                         if words.word(i) != phrases.words[int(phrases.numbers(hashes[i:i + 1])[0])]}
                if wrong:
                    bad = np.array([any(i in wrong for i in range(s // (window + 1), s // (window + 1) + s % (window + 1))) for s in spans.tolist()])
                    same = ~bad[back]
                at, length, which = at[same], length[same], which[same]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                doc = np.searchsorted(words.first, at, side="right") - 1
                for pair in np.unique(doc * len(phrases.phrases) + which).tolist():
                    doc_items[pair // len(phrases.phrases)].update(
                        phrases.ids[i] for i in phrases.owners[pair % len(phrases.phrases)] if phrases.ids[i] is not None)
        hit = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[words.first[1:]] - total[words.first[:-1]]
        first, last, spans_of = _spans(hit, words.first)
        items = [sorted(s) for s in doc_items]
        pairs = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["first", "last"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(spans_of)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(words.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
             pa.ListArray.from_arrays(offsets, pairs)], [*kept, *FOUND])

    return map_arrow(source, search, schema, SHARD_BYTES, len(kept))


def _covered(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Every number inside the runs, once."""
    begins = np.cumsum(length) - length
    return np.unique(np.arange(int(length.sum())) - np.repeat(begins, length) + np.repeat(first, length))


def _spans(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words within documents, as word numbers in the document, and runs per document."""
    edge = np.zeros(len(hit), bool)
    edge[first[:-1][first[:-1] < len(hit)]] = True
    before = np.append(False, hit[:-1]) & ~edge if len(hit) else hit
    starts = np.flatnonzero(hit & ~before)
    after = np.append(hit[1:] & ~edge[1:], False) if len(hit) else hit
    ends = np.flatnonzero(hit & ~after) + 1
    doc = np.searchsorted(first, starts, side="right") - 1
    return starts - first[doc], ends - first[doc], np.bincount(doc, minlength=len(first) - 1)
