"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed rows: what a document counted so far
is taken back with sign -1, what it counts now is added with +1. Summed by source, language and tokenizer
version they are the batch's deltas, and totals are the sum of all committed deltas.

A batch writes to a folder of its own and is committed by one row that names the folder; a batch
id that is committed already is left alone, so a batch may be repeated after any failure. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridsight.functions.scale import saved, shared_folder

GROUP = ["source", "lang", "tokenizer"]
CHANGE = ["key", "op", *GROUP, "n_tokens"]


class TokenLedger:
    """Signed counts in a folder: ``rows`` and ``deltas`` of each committed batch."""

    def __init__(self, spark: SparkSession, folder: str | None = None, key_type: str = "bigint"):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/gridsight/ledger-{uuid.uuid4().hex}"
        self.kinds = {"rows": f"key {key_type}, source string, lang string, tokenizer string, n_tokens bigint, sign int",
                      "deltas": "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"}

    def _commits(self) -> dict[str, str]:
        """Committed batch ids and their folders; one row per batch."""
        try:
            rows = self.spark.read.schema("batch string, folder string").parquet(f"{self.folder}/commits").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return {}
        # Should two attempts have committed the same batch, the first folder by name counts, for all readers.
        return {r["batch"]: r["folder"] for r in sorted(rows, key=lambda r: r["folder"], reverse=True)}

    def _all(self, table: str) -> DataFrame:
        folders = [f"{f}/{table}" for f in self._commits().values()]
        reader = self.spark.read.schema(self.kinds[table])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.kinds[table])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes ``(key, op, source, lang, tokenizer, n_tokens)``; False if the batch was committed before.

        ``op`` is ``delete`` or anything else for an insert or revision; a delete needs only key and
        tokenizer. A document counts once per tokenizer. Of several changes of one in a batch the
        delete wins, then the largest count, then the first group by name. A revision may move a document to another source or
        language. Rows without key cannot be revised: their inserts add up and their deletes do nothing. Null
        groups are groups; a null count is 0; deleting what is not there changes nothing.
        """
        if batch in self._commits():
            return False
        rows = changes.select("key", (F.coalesce("op", F.lit("")) == "delete").alias("gone"), *[F.col(c).cast("string").alias(c) for c in GROUP],
                              F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"))
        order = W.partitionBy("key", "tokenizer").orderBy(F.desc("gone"), F.desc("n_tokens"), "source", "lang")
        keyed = saved(rows.filter("key is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n"))
        touched = keyed.select("key", "tokenizer")
        net = self._all("rows").filter("key is not null").alias("old").join(
            touched.alias("new"), (F.col("old.key") == F.col("new.key")) & F.col("old.tokenizer").eqNullSafe(F.col("new.tokenizer")), "left_semi")
        before = net.groupBy("key", *GROUP, "n_tokens").agg(F.sum("sign").alias("net")).filter("net > 0").select(
            "key", *GROUP, "n_tokens", F.lit(-1).alias("sign"))
        fresh = keyed.unionByName(rows.filter("key is null")).filter("not gone").select("key", *GROUP, "n_tokens", F.lit(1).alias("sign"))
        folder = f"{self.folder}/batch-{uuid.uuid4().hex}"
        before.unionByName(fresh).write.parquet(f"{folder}/rows")
        signed = self.spark.read.schema(self.kinds["rows"]).parquet(f"{folder}/rows")
        signed.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).write.parquet(f"{folder}/deltas")
        self.spark.createDataFrame([(batch, folder)], "batch string, folder string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups that no document is left in are absent."""
        return self._all("deltas").groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0")
