"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) by
parameter mixing: each round, PARTS parts of the training sample start from the shared state and
their states are averaged. A temperature fitted on rows kept out of training calibrates the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.scale import saved
from gridsight.llm.batches import lists, pieces

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = 3
#: Rows per language that the model is fitted on, at most (in the mean of a hash draw).
FIT_ROWS = 2000
PARTS = 8
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02

LETTERS = re.compile(r"[^\W\d_]+")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Rows that nothing is learned from: a fold of crc32 of the key as text, and rows without key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(True))


def grams(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a text's letters and how often each occurs."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    code, counts = points.copy(), np.zeros(buckets, np.int64)
    for order in range(ORDERS):
        if order:
            code = code[:-1] * np.uint64(0x100000001B3) + points[order:]
        counts += np.bincount(((code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64), minlength=buckets)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text's buckets, scaled to length 1."""
    values = (1 + np.log(counts)) * idf[found]
    return values / max(1e-12, np.sqrt(values @ values))


@dataclass
class LanguageModel:
    """Learned languages, inverse document frequencies, weights (buckets x languages) and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0


def _document_frequencies(rows: DataFrame, buckets: int) -> tuple[int, np.ndarray]:
    """In how many of all rows each bucket occurs: a sum per task, added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in (t for piece in pieces(batch, column=0) for t in piece.column(0).to_pylist()):
                total[grams(text, buckets)[0]] += 1
                rows += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], rows))], ["bucket", "rows"])

    sums = rows.select("text").mapInArrow(count, "bucket bigint, rows bigint").groupBy("bucket").agg(F.sum("rows").alias("rows")).collect()
    frequency = np.zeros(buckets, np.int64)
    for row in sums:
        if row["bucket"] >= 0:
            frequency[row["bucket"]] = row["rows"]
    return next((r["rows"] for r in sums if r["bucket"] == -1), 0), frequency


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that minimise the regularised sum of all past losses."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _fit_round(sample: DataFrame, state: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    shared = sample.sparkSession.sparkContext.broadcast(state)

    def learn(part: pa.Table) -> pa.Table:
        z, n = (s.copy() for s in shared.value)
        for row in part.sort_by([("order", "ascending")]).select(["label", "found", "values"]).to_batches(max_chunksize=64):
            for label, found, values in zip(row.column(0).to_pylist(), row.column(1), row.column(2)):
                at, x = found.values.to_numpy(), values.values.to_numpy()
                old_z, old_n = z[at], n[at]
                weights = _leader(old_z, old_n)
                error = _softmax(x @ weights)
                error[label] -= 1
                step = x[:, None] * error
                new_n = old_n + step * step
                z[at] = old_z + step - (np.sqrt(new_n) - np.sqrt(old_n)) / ALPHA * weights
                n[at] = new_n
        return pa.table([pa.array([z.tobytes()]), pa.array([n.tobytes()])], names=["z", "n"])

    # PARTS rows of fixed size come back, whatever the data.
    parts = sample.groupBy("part").applyInArrow(learn, "z binary, n binary").collect()
    if not parts:
        return state
    return tuple(np.mean([np.frombuffer(p[name]) for p in parts], axis=0).reshape(state[0].shape) for name in ("z", "n"))


def fit(documents: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> LanguageModel:
    """Learn from the rows for which ``learnable`` holds and ``lang`` is not null.

    Document frequencies cover all those rows. The weights are fitted on about ``fit_rows`` rows
    of each language, drawn by a hash of the key; a fifth of them is kept for the temperature.
    """
    rows = documents.filter(learnable & F.col(lang).isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    total, frequency = _document_frequencies(rows, buckets)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    model = LanguageModel(langs, idf, np.zeros((buckets, len(langs))))
    if not langs:
        return model
    limits = F.create_map(*[F.lit(v) for name in langs for v in (name, min(1.0, fit_rows / sizes[name]))])
    draw = F.xxhash64(F.col("key"), F.lit("language"))
    drawn = rows.filter(F.pmod(draw, F.lit(1 << 20)) < limits[F.col("lang")] * (1 << 20)).select(
        F.shiftright(draw, 20).alias("order"), "text", (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                vectors = [grams(t, buckets) for t in piece.column(1).to_pylist()]
                sizes = [len(found) for found, _ in vectors]
                flat = [np.concatenate([np.zeros(0), *parts]) for parts in ([f for f, _ in vectors], [weigh(f, c, idf) for f, c in vectors])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), lists(flat[0].astype(np.int32), sizes, pa.int32()), lists(flat[1], sizes, pa.float64())],
                    ["order", "label", "found", "values"])

    sample = saved(drawn.mapInArrow(features, "order bigint, label int, found array<int>, values array<double>")
                   .filter(F.size("found") > 0).withColumn("part", F.pmod("order", F.lit(PARTS * 5)) % PARTS)
                   .withColumn("keep", F.pmod("order", F.lit(PARTS * 5)) < PARTS))
    state = (np.zeros((buckets, len(langs))), np.zeros((buckets, len(langs))))
    for _ in range(ROUNDS):
        state = _fit_round(sample.filter("not keep"), state)
    model.weights = _leader(*state)
    model.temperature = _temperature(sample.filter("keep"), model)
    return model


def _temperature(kept: DataFrame, model: LanguageModel) -> float:
    """The temperature of least log loss on rows that were not trained on; 1 if there are none.

    Targets are smoothed by one row of every other language, as without errors there is no least loss.
    """
    weights = kept.sparkSession.sparkContext.broadcast(model.weights)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [(v.values.to_numpy() @ weights.value[f.values.to_numpy()]).tolist() for f, v in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.list_(pa.float64()))], ["label", "scores"])

    # A fifth of the bounded sample, one number per language.
    rows = kept.select("label", "found", "values").mapInArrow(logits, "label int, scores array<double>").collect()
    if not rows:
        return 1.0
    labels, scores = np.array([r["label"] for r in rows]), np.array([r["scores"] for r in rows])
    low, high = np.log(0.02), np.log(50.0)
    target = np.full(scores.shape, 1 / (len(rows) + scores.shape[1]))
    target[np.arange(len(rows)), labels] = (len(rows) + 1) / (len(rows) + scores.shape[1])

    def loss(log_t: float) -> float:
        return -(target * np.log(np.maximum(_softmax(scores / np.exp(log_t)), 1e-300))).sum(axis=1).mean()

    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and its probability ``score`` to every row, from the text alone.

    A text that is null or has no letters, and any text if no language was learned, is ``und``
    with score 0. Ties go to the first language in alphabetical order.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.langs, model.idf, model.weights.astype(np.float32), model.temperature))
    schema = documents.drop("lang_pred", "score").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    columns = [f.name for f in schema][:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, weights, temperature = shared.value
        for batch in (piece for b in batches for piece in pieces(b, column=columns.index(text))):
            names, scores = [], []
            for value in batch.column(text).to_pylist():
                found, counts = grams(value, len(idf))
                if not len(found) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                chances = _softmax(weigh(found, counts, idf) @ weights[found] / temperature)
                best = int(chances.argmax())
                names.append(langs[best])
                scores.append(float(chances[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*columns, "lang_pred", "score"])

    return documents.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
