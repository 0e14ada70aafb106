"""Training-data pipeline over the documents table.

Stages, in order: quality classifier, language ID, SimHash near-dedup, benchmark
decontamination, byte-level BPE. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridsight.functions.scale import saved
from gridsight.llm import decontaminate, queries, simhash
from gridsight.queries.registry import table

#: A document whose most likely language has a smaller chance is rejected, as is one without letters.
LEAST_CHANCE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the held-in labels of ``docs``, predicts to be of quality 1."""
    return queries.qualities(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: letters, and a most likely language of at least LEAST_CHANCE."""
    return queries.languages(docs).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CHANCE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Of a group's rows with that doc_id the first by text stays. A doc_id that is repeated over unrelated texts
    stays once in each of their groups. Rows without doc_id stay.
    """
    rows = saved(simhash.with_fingerprints(docs))
    prints = rows.select("doc_id", "bits")
    first = saved(prints.join(simhash.groups(prints), "bits").filter("doc_id = component_id").select("doc_id", "bits", "root").distinct())
    order = W.partitionBy("doc_id", "root").orderBy(*[c for c in docs.columns if c != "doc_id"])
    kept = rows.join(first, ["doc_id", "bits"]).withColumn("_row", F.row_number().over(order)).filter("_row = 1")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter("n_hit = 0").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded documents."""
    return queries.token_digests(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: Learned classifiers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two, rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs)
    return docs
