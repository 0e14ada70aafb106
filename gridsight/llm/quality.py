"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, each over the bins of one feature, are boosted in cycles over all features; the sum
of a feature's trees is a lookup table. The pairs of features that explain most of what is left
get tables of their own in the same way. A score is a sum of table entries, read for many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridsight.llm.batches import pieces, text_bytes

#: Labelled rows that the model is fitted on, at most (in the mean of a hash draw).
FIT_ROWS = 20_000
BINS = 48
PAIR_BINS = 8
PAIRS = 8
ROUNDS, PAIR_ROUNDS = 150, 60
RATE, PENALTY = 0.15, 2.0
CUT = 0.7

FEATURES = ["log_chars", "upper", "lower", "digits", "spaces", "stops", "marks", "symbols", "beyond_ascii", "entropy",
            "word_length", "distinct_words", "words_per_line", "distinct_lines", "symbol_words"]

_CODES = np.arange(256)


def _class(chars: str) -> np.ndarray:
    return np.isin(_CODES, [ord(c) for c in chars]).astype(float)


# Characters by class: upper, lower, digits, spaces, sentence stops, other marks, symbols, and bytes that begin a character beyond ASCII.
_CLASSES = np.stack([
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"), _class(" \t\r\n\v\f"),
    _class(".!?"), _class(",;:'\"()-"), _class("#$%&*+/<=>@[\\]^_`{|}~"), (_CODES >= 0xC0).astype(float)], axis=1)
_TAIL = frozenset("#$%&*+/<=>@[\\]^_`{|}~!")


def features(piece: pa.RecordBatch, column: int) -> np.ndarray:
    """A row of FEATURES per text, from the whole text; all 0 for a null or empty one."""
    joined, offsets = text_bytes(piece.column(column))
    rows = np.zeros((piece.num_rows, len(FEATURES)))
    for row, text in enumerate(piece.column(column).to_pylist()):
        if not text:
            continue
        bytes_of = np.bincount(joined[offsets[row]:offsets[row + 1]], minlength=256)
        share = bytes_of[bytes_of > 0] / bytes_of.sum()
        words, lines = text.split(), text.split("\n")
        count = max(1, len(words))
        rows[row] = [np.log(len(text)), *(bytes_of @ _CLASSES / len(text)), -(share @ np.log(share)), sum(map(len, words)) / count,
                     len(set(words)) / count, len(words) / len(lines), len(set(lines)) / len(lines), sum(w[-1] in _TAIL for w in words) / count]
    return rows


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables. Plain fields, so that a broadcast carries it as a dict."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)


def score(state: dict, rows: np.ndarray) -> np.ndarray:
    """The chance of label 1 for rows of features: entries of all tables, added up."""
    total = np.full(len(rows), state["base"])
    bins = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(state["edges"])]
    for own, table in zip(bins, state["tables"]):
        total += table[own]
    for (i, j), table in state["pairs"].items():
        total += table[state["coarse"][i][bins[i]], state["coarse"][j][bins[j]]]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h):
    return g * g / (h + PENALTY)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The cut of a row of bins that lowers the loss most: its gain and how many bins lie left of it."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    best = int(gains.argmax())
    return float(gains[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth 2 over a row of bins, as its value in each bin."""
    values = np.zeros(len(g))
    gain, cut = _best_cut(g, h)
    bounds = [0, len(g)] if gain <= 0 else [0, cut, len(g)]
    for begin, end in zip(bounds, bounds[1:]):
        inner, at = _best_cut(g[begin:end], h[begin:end])
        parts = [begin, end] if inner <= 0 else [begin, begin + at, end]
        for a, b in zip(parts, parts[1:]):
            values[a:b] = -g[a:b].sum() / (h[a:b].sum() + PENALTY)
    return values


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of depth 2 over a table of bins that cuts one feature and then the other: gain and values."""
    best, values = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            gain, own = -_gain(gg.sum(), hh.sum()), np.zeros(gg.shape)
            for side in (slice(0, cut), slice(cut, None)):
                row_g, row_h = gg[side].sum(axis=0), hh[side].sum(axis=0)
                inner, at = _best_cut(row_g, row_h)
                gain += inner + _gain(row_g.sum(), row_h.sum())
                for part in (slice(0, at), slice(at, None)) if inner > 0 else (slice(0, None),):
                    own[side, part] = -row_g[part].sum() / (row_h[part].sum() + PENALTY)
            if gain > best:
                best, values = gain, own.T if turned else own
    return best, values


def fit_tables(rows: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Boost the tables on a bounded sample of feature rows. Without two classes the score is the share of label 1."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(np.unique(labels)) < 2:
        return model
    total = np.full(len(labels), model.base)
    slopes = lambda: ((p := 1 / (1 + np.exp(-total))) - labels, p * (1 - p))
    model.edges = [np.unique(np.quantile(rows[:, j], np.arange(1, BINS) / BINS)) for j in range(rows.shape[1])]
    bins = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(model.edges)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    for _ in range(ROUNDS):
        for j, own in enumerate(bins):
            g, h = slopes()
            tree = RATE * _tree(np.bincount(own, g, sizes[j]), np.bincount(own, h, sizes[j]))
            model.tables[j] += tree
            total += tree[own]
    model.coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in sizes]
    wide = [c[b] for c, b in zip(model.coarse, bins)]

    def cells(pair, values):
        return np.bincount(wide[pair[0]] * PAIR_BINS + wide[pair[1]], values, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    ranked = sorted(combinations(range(len(sizes)), 2), key=lambda p: -_pair_tree(cells(p, g), cells(p, h))[0])
    model.pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for pair, table in model.pairs.items():
            g, h = slopes()
            tree = RATE * _pair_tree(cells(pair, g), cells(pair, h))[1]
            table += tree
            total += tree[wide[pair[0]], wide[pair[1]]]
    return model


def fit(documents: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
        fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Learn from the labelled rows for which ``learnable``, a condition on the key, holds.

    About ``fit_rows`` labels are drawn by a hash of the key, which bounds the broadcast
    and the feature rows that reach the driver. Null labels and keys are left out; repeated rows count
    as often as they occur.
    """
    known = labels.filter(learnable & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    count = known.count()
    drawn = known.filter(F.pmod(F.xxhash64("_key", F.lit("quality")), F.lit(1 << 20)) < min(1.0, fit_rows / max(1, count)) * (1 << 20))
    rows = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(drawn), "_key")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(features(piece, 1).tolist(), pa.list_(pa.float64()))], ["label", "row"])

    sample = rows.select("_label", "text").mapInArrow(measure, "label int, row array<double>").collect()
    sample.sort(key=lambda r: (r["label"], r["row"]))
    table = np.array([r["row"] for r in sample]).reshape(-1, len(FEATURES))
    return fit_tables(table, np.array([r["label"] for r in sample], float))


def predict(documents: DataFrame, model: AdditiveModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """Add ``score`` (chance of label 1) and ``predicted`` (1 from ``cut`` on) to every row, from the text alone.

    Null and empty texts are scored as texts whose features are all 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    schema = documents.drop("score", "predicted").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    columns = [f.name for f in schema][:-2]
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in pieces(b, column=place)):
            scores = score(shared.value, features(batch, place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                                             [*columns, "score", "predicted"])

    return documents.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
