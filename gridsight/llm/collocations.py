"""Phrase collocations, counted over a prefix-free parse of the corpus.

A document is a stream of words. A pair of words whose hash is a multiple of SPACING is a trigger: a chunk ends and the
next begins there, so equal passages are cut alike wherever they stand. Chunks overlap by as many words as a phrase
can reach over a cut. The dictionary holds each distinct chunk with its frequency; phrases are counted inside distinct chunks, times the
frequency, and a phrase that begins in the overlap belongs to the next chunk alone.

Rare phrases are kept out of the shuffle by tables of bits: a pass sums the occurrences of all phrases of a hash
bucket, and a bucket below the least count holds no candidate. The buckets are as many at any input; the more
phrases share them the less is kept out, and the counts of what remains are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gridsight.functions.scale import saved
from gridsight.llm.batches import Words, map_arrow, ranges, texts
from gridsight.llm.lookups import with_totals

#: One pair of words in so many is a trigger.
SPACING = 32
#: A run without trigger is cut after so many words of its chunk.
CHUNK_WORDS = 2048
#: Buckets of rare phrases, as a power of two: 8 MB of bits per length of phrase.
FILTER_BITS = 26
GROUP_BITS = 8
#: Text of distinct chunks that one step counts together.
STEP_BYTES = 4_000_000
#: Occurrences, phrases for each language, and the percentage of a phrase that a longer one must cover to replace it.
LEAST, TOP, COVERED = 10, 2000, 50
SALTS = 32

_BYTES = np.arange(256)
_BREAKS = np.isin(_BYTES, [ord(c) for c in ".,;:!?"]) | ((_BYTES >= 0x0A) & (_BYTES <= 0x0D))
_WORD = ~_BREAKS & (_BYTES != 0x20) & (_BYTES != 0x09)
# Inside a chunk one space or, where a piece ends, one line feed follows each word.
_SPACE, _END = 0x20, 0x0A
_PARSED = (_BYTES != _SPACE) & (_BYTES != _END)
_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _NEXT
    return values ^ (values >> np.uint64(29))


def parse(batch: pa.RecordBatch, reach: int) -> pa.RecordBatch:
    """The chunks of texts: ``lang, chunk, overlap, words``, the last two the words after the chunk's own and its own."""
    words = Words(batch.column(1), _WORD)
    count = len(words)
    lengths = words.ends - words.starts
    passed = np.concatenate([[0], np.cumsum(_BREAKS[words.low])])
    # No phrase reaches over the gap before a torn word.
    torn = np.ones(count + reach + 1, bool)
    torn[1:count] = passed[words.starts[1:]] > passed[words.ends[:-1]]
    heads = words.first[:-1][words.counts() > 0]
    torn[heads] = True
    hashes = words.hashes()
    cuts = np.zeros(count, bool)
    cuts[:-1] = _mixed(hashes[:-1] * _FIRST + hashes[1:]) % np.uint64(SPACING) == 0
    # The last word of a text has no pair of its own.
    cuts[words.first[1:][words.counts() > 0] - 1] = False
    cuts[heads] = True
    begins = np.flatnonzero(cuts)
    for begin, end in zip(begins, np.append(begins[1:], count)):
        if end - begin > CHUNK_WORDS:
            cuts[np.arange(begin + CHUNK_WORDS, end, CHUNK_WORDS)] = True
    begins = np.flatnonzero(cuts)
    ends = np.append(begins[1:], count)[:len(begins)]
    overlap, open_ = np.zeros(len(begins), np.int32), np.ones(len(begins), bool)
    for step in range(reach):
        open_ &= ~torn[ends + step]
        overlap += open_
    # Every word and one byte after it.
    data = np.empty(int(lengths.sum()) + count, np.uint8)
    places = np.cumsum(lengths + 1) - lengths - 1
    data[np.arange(len(data) - count) + np.repeat(np.arange(count), lengths)] = words.low[words.inside]
    data[places + lengths] = np.where(torn[1:count + 1], _END, _SPACE)
    last = ends + overlap - 1
    chunk = texts(*ranges(data, places[begins], places[last] + lengths[last]))
    rows = np.searchsorted(words.first, begins, side="right") - 1
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(rows)), chunk.cast(pa.string()), pa.array(overlap), pa.array((ends - begins).astype(np.int32))],
        ["lang", "chunk", "overlap", "words"])


class Phrases:
    """The phrases of distinct chunks by the word where they begin, and how often each of these places occurs in the corpus."""

    def __init__(self, batch: pa.RecordBatch):
        words = Words(batch.column(1), _PARSED)
        self.words, self.count = words, len(words)
        row = np.repeat(np.arange(batch.num_rows), words.counts())
        place = np.arange(self.count) - words.first[row]
        self.own = place < (words.counts() - batch.column(2).to_numpy())[row]
        self.times = batch.column(4).to_numpy()[row]
        # torn[i]: a piece or a chunk ends before word i.
        self.torn = np.ones(self.count + 1, bool)
        self.torn[1:self.count] = (place[1:] == 0) | (words.low[np.minimum(words.ends[:-1], len(words.low) - 1)] == _END)
        langs = batch.column(0).dictionary_encode()
        seeds = np.array([_seed(x) for x in langs.dictionary.to_pylist()], np.uint64)
        self.langs = langs.take(pa.array(row))
        self.seeds = seeds[langs.indices.to_numpy()[row]]

    def lengths(self, tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 word, 2 words, … up to one more than there are tables: which phrases may be frequent as their parts are, their
        buckets, and which of them are in a full bucket (all, where there is no table)."""
        single = self.words.hashes()
        places = np.arange(self.count)
        fits = full = np.ones(self.count, bool)
        hashes = _mixed(single * _FIRST + self.seeds)
        for length in range(1, len(tables) + 2):
            alive = fits
            if length > 1:
                end = places + length - 1
                fits = fits & ~self.torn[np.minimum(end, self.count)]
                hashes = _mixed(hashes * _FIRST + single[np.minimum(end, self.count - 1)])
                alive = fits & full & np.append(full[1:], False)
            buckets = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            full = alive
            if length <= len(tables):
                full = alive & (tables[length - 1][buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)
            yield alive, buckets, full


def _seed(text: str) -> int:
    """A 64-bit number of a short text, the same in every process."""
    number = 0xCBF29CE484222325
    for byte in text.encode():
        number = (number ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return number


def _steps(function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """Apply a function to about STEP_BYTES of chunks at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.column(1).nbytes
            if size >= STEP_BYTES:
                yield from function(_joined(waiting))
                waiting, size = [], 0
                pa.default_memory_pool().release_unused()
        if sum(b.num_rows for b in waiting):
            yield from function(_joined(waiting))
    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def full_buckets(dictionary: DataFrame, tables: list[np.ndarray], least: int) -> np.ndarray:
    """The table of bits for phrases of one word more than the tables have: buckets with ``least`` occurrences or more.

    A task adds up the buckets it meets and sends them in packed groups, counts above ``least`` cut to it. One group is
    2^(FILTER_BITS - GROUP_BITS) counters, whatever the input.
    """
    shared = dictionary.sparkSession.sparkContext.broadcast(tables)
    low = FILTER_BITS - GROUP_BITS
    kind = np.min_scalar_type(least)

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(batch)
        *_, (alive, buckets, _) = phrases.lengths(shared.value)
        chosen = alive & phrases.own
        found, times = buckets[chosen], phrases.times[chosen]
        if not len(found):
            return
        order = np.argsort(found, kind="stable")
        found, times = found[order], times[order]
        edges = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        sums = np.minimum(np.add.reduceat(times, edges), least).astype(kind)
        found = found[edges]
        bounds = np.searchsorted(found >> low, np.arange((1 << GROUP_BITS) + 1))
        inner = (found & ((1 << low) - 1)).astype(np.uint32)
        pick = pa.array(np.flatnonzero(np.diff(bounds)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pick, texts(inner.view(np.uint8), bounds * 4, pa.large_binary()).take(pick).cast(pa.binary()),
             texts(sums.view(np.uint8), bounds * kind.itemsize, pa.large_binary()).take(pick).cast(pa.binary())], ["group", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = totals.setdefault(group, np.zeros(1 << low, np.min_scalar_type(2 * least)))
                at = np.frombuffer(places, np.uint32)
                total[at] = np.minimum(total[at] + np.frombuffer(counts, kind).astype(total.dtype), least)
        for group, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])],
                                             ["group", "bits"])

    packed = dictionary.mapInArrow(_steps(pack), "group int, places binary, counts binary")
    bits = np.zeros((1 << GROUP_BITS, (1 << low) // 8), np.uint8)
    for row in packed.repartition("group").mapInArrow(add, "group int, bits binary").collect():
        bits[row["group"]] = np.frombuffer(row["bits"], np.uint8)
    shared.destroy()
    return bits.reshape(-1)


def phrase_counts(dictionary: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases of up to ``longest`` words with ``least`` occurrences or more."""
    tables: list[np.ndarray] = []
    for _ in range(longest):
        tables.append(full_buckets(dictionary, tables, least))
    shared = dictionary.sparkSession.sparkContext.broadcast(tables)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(batch)
        words = phrases.words
        for length, (_, _, full) in zip(range(1, longest + 1), phrases.lengths(shared.value)):
            places = np.flatnonzero(full & phrases.own)
            found = pa.Table.from_arrays([phrases.langs.take(pa.array(places)),
                                          texts(*ranges(words.low, words.starts[places], words.ends[places + length - 1])).cast(pa.string()),
                                          pa.array(phrases.times[places])], ["lang", "phrase", "f"])
            sums = found.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            sums = sums.select(["lang", "phrase", "f_sum"]).append_column("words", pa.array(np.full(len(sums), length, np.int32)))
            for part in sums.unify_dictionaries().combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), part.column(3), part.column(2)],
                                                 ["lang", "phrase", "words", "f"])

    counted = dictionary.mapInArrow(_steps(count), "lang string, phrase string, words int, f bigint")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def dictionary_of(documents: DataFrame, longest: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, chunk, overlap, words, times``: each distinct chunk of the parse and its frequency. A null language is ``und``."""
    source = documents.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                              F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    chunks = map_arrow(source, lambda batch: parse(batch, longest - 1), "lang string, chunk string, overlap int, words int")
    return chunks.groupBy("lang", "chunk", "overlap", "words").agg(F.count("*").alias("times")).select("lang", "chunk", "overlap", "words", "times")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", shortest: int = 2, longest: int = 3, least: int = LEAST,
                 top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The phrases of each language that hold together most: ``lang, rank, phrase, words, cut, a, l, r, n, score``.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\n-\\r]`` into pieces, these at spaces and tabs into words. ``a`` counts a
    phrase, ``n`` all words of the language; a phrase cut after ``cut`` words scores floor(10^6 a a / (l r)), by the counts of
    both sides at its worst cut, ties to the first. A phrase is left out if a longer candidate that holds it occurs in at
    least ``covered`` percent of its places. Ranks go by score, then ``a``, then bytes.

    Null and empty texts have no words, a null language is ``und``, repeated rows count as often as they stand there, other
    columns are not read, and a table without rows gives none. Counts below 10^16 are exact.
    """
    dictionary = saved(dictionary_of(documents, longest, text, lang))
    sizes = dictionary.groupBy("lang").agg(F.sum(F.col("words") * F.col("times")).alias("n"))
    return ranked(saved(phrase_counts(dictionary, longest, least)), sizes, shortest, top, covered)


def ranked(counts: DataFrame, sizes: DataFrame, shortest: int = 2, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The result of ``collocations`` from ``lang, phrase, words, f`` of all frequent phrases and ``lang, n``."""
    candidates = counts.filter(F.col("words") >= shortest)
    # Both sides of each cut; they are at least as frequent as the phrase, so they are counted.
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("left", F.expr("substring_index(phrase, ' ', cut)"))
    cut = cut.withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = with_totals(with_totals(cut, side("left", "l"), ["lang", "left"], "l"), side("right", "r"), ["lang", "right"], "r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"_up": (wide("f") * wide("f") * F.lit(1_000_000)).cast("decimal(38,0)"), "_down": (wide("l") * wide("r")).cast("decimal(38,0)")})
    scored = cut.withColumn("score", F.expr("_up div _down")).groupBy("lang", "phrase", "words", F.col("f").alias("a")).agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "words", "a", "s.*")
    within = F.expr(f"""explode(flatten(transform(sequence({shortest}, words - 1), m -> transform(sequence(0, words - m),
        s -> array_join(slice(split(phrase, ' '), s + 1, m), ' ')))))""")
    longer = candidates.filter(F.col("words") > shortest).select("lang", "f", within.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter("_longer is null or 100 * _longer < %d * a" % covered).drop("_longer")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language's best are the best of its parts' best, so no part and no language is gathered whole.
    parts = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_part"], ["lang"]):
        parts = parts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= top)
    return parts.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "words", "cut", "a", "l", "r", "n", "score")
