"""Classifiers: held-out accuracy and defined results for odd rows."""

import zlib

from pyspark.sql import functions as F

from gridsight.llm import language, quality
from gridsight.llm.queries import QUERIES


def test_language_query(spark, folder):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_ftrl_language_id"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    kept = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in kept) >= 0.95 * len(kept)


def test_language_odd_rows(spark):
    known = [(i, t, l, "x") for i in range(60) for t, l in [(f"the house and the garden {i}", "en"), (f"das haus und der garten {i}", "de")]]
    odd = [(1, None, "en", "x"), (2, "", None, "x"), (3, "123 !!! 456", "en", "x"), (None, "the garden", "en", "x"), (4, "Das Haus " * 20_000, None, "x"), (4, "the house", None, "x")]
    docs = spark.createDataFrame(known + odd, "doc_id bigint, text string, lang string, score string")
    model = language.fit(docs, ~language.held_out(F.col("doc_id"), 5, 0))
    assert model.langs == ["de", "en"] and 0.02 <= model.temperature <= 50
    found = language.predict(spark.createDataFrame(odd, "doc_id bigint, text string, lang string, score string"), model)
    got = [(r["doc_id"], r["lang_pred"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "en")], key=str)
    empty = language.fit(docs.limit(0), F.lit(True))
    assert [r["lang_pred"] for r in language.predict(docs.limit(3), empty).collect()] == ["und"] * 3


def test_quality_query(spark, folder):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op9_additive_quality"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    kept = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in kept) >= 0.85 * len(kept)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("fine words here. " if i % 2 else "### $$$ !!! ") * (i % 5 + 3), "x") for i in range(200)]
                                 + [(900, None, "x"), (901, "", "x"), (None, "fine words here.", "x"), (902, "fine words. " * 30_000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, None), (None, 1), (3, 1), (3, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    found = {r["doc_id"]: r for r in quality.predict(docs, model).collect()}
    assert all(found[i]["predicted"] == i % 2 for i in range(200)) and 0 <= found[900]["score"] == found[901]["score"] <= 1
    one = quality.fit(docs, labels.filter("quality = 1"), F.lit(True))
    assert all(0.5 < r["score"] < 1 for r in quality.predict(docs.limit(3), one).collect())
    assert quality.predict(docs.limit(0), quality.fit(docs, labels.limit(0), F.lit(True))).count() == 0


def test_interactions_are_learned():
    import numpy as np
    random = np.random.default_rng(1)
    rows = random.random((4000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.fit_tables(rows, labels)
    assert ((quality.score(vars(model), rows) > 0.5) == labels).mean() > 0.9
