"""Dataset catalog queries over documents, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsight.operators import catalog
from gridsight.queries.registry import prepared, query, table

ROW_SQL = "sha256({})"


def _digest(columns: list[str]) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-1:' ELSE CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END" for c in columns) + ")"


# The balance in whole cents, as engines write out doubles differently.
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "cents"]


@query("table_fingerprint", f"""WITH r AS (SELECT {_digest(CUSTOMER)} AS h FROM (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)),
s AS (SELECT {', '.join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS h{i}" for i in range(4))}, count(*) AS n FROM r)
SELECT sha256(CAST(h0 AS VARCHAR) || '|' || CAST(h1 AS VARCHAR) || '|' || CAST(h2 AS VARCHAR) || '|' || CAST(h3 AS VARCHAR) || '|' || CAST(n AS VARCHAR)) AS fingerprint, n AS row_count FROM s""")
def table_fingerprint(spark, folder):
    return catalog.table_fingerprint(table(spark, folder, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("bigint")).select(*CUSTOMER))


@query("row_fingerprints", f"SELECT doc_id, {_digest(['doc_id', 'text', 'lang', 'source', 'n_chars'])} AS fingerprint FROM documents")
def row_fingerprints(spark, folder):
    return table(spark, folder, "documents").select("doc_id", catalog.row_fingerprint(table(spark, folder, "documents"), ["doc_id", "text", "lang", "source", "n_chars"]).alias("fingerprint"))


@query("file_fingerprints")
def file_fingerprints(spark, folder):
    return catalog.file_fingerprints(spark, folder, "*.parquet").select("byte_size", "fingerprint")


@query("exact_duplicates", f"""WITH m AS (SELECT doc_id AS key, {_digest(['text'])} AS fingerprint FROM documents), g AS (SELECT fingerprint, min(key) AS first_key, count(*) AS copies FROM m GROUP BY fingerprint HAVING count(*) > 1)
SELECT m.key, m.fingerprint, first_key, copies FROM m JOIN g USING (fingerprint) WHERE m.key <> first_key""")
def exact_duplicates(spark, folder):
    return catalog.exact_duplicates(table(spark, folder, "documents"), "doc_id", ["text"])


# Uploads from the event stream: a file per user and type, its content by value.
UPLOADS = """SELECT event_id, ts AS uploaded_at, event_type || '-' || CAST(user_id % 5 AS STRING) || '.csv' AS filename,
 event_type || '/' || CAST(user_id % 20 AS STRING) || '/' || CAST(event_id % 40 AS STRING) AS fingerprint, event_id % 3 = 0 AS deleted FROM {events}"""


def _uploads(spark, folder):
    return prepared(spark, folder, UPLOADS)


@query("version_chain", f"""WITH u AS ({UPLOADS}), f AS (SELECT fingerprint, arg_min(filename, (uploaded_at, event_id, filename)) AS filename, min((uploaded_at, event_id)) AS m FROM u GROUP BY fingerprint),
v AS (SELECT fingerprint, filename, m[1] AS uploaded_at, m[2] AS event_id FROM f)
SELECT fingerprint, filename, uploaded_at, event_id, row_number() OVER w AS version, lag(fingerprint) OVER w AS previous_fingerprint FROM v WINDOW w AS (PARTITION BY filename ORDER BY uploaded_at, event_id, fingerprint)""")
def version_chain(spark, folder):
    return catalog.version_chain(_uploads(spark, folder), "filename", "uploaded_at", "fingerprint", tie="event_id")


MASTERS = f"SELECT DISTINCT fingerprint FROM ({UPLOADS}) u UNION ALL SELECT 'never-referenced'"


@query("reference_counts", f"""WITH u AS ({UPLOADS}), m AS ({MASTERS}) SELECT m.fingerprint, count(event_id) FILTER (NOT deleted) AS reference_count, max(uploaded_at) AS last_referenced_at
 FROM m LEFT JOIN u ON m.fingerprint = u.fingerprint GROUP BY m.fingerprint""")
def reference_counts(spark, folder):
    return catalog.reference_counts(prepared(spark, folder, MASTERS), _uploads(spark, folder), "fingerprint", "deleted", "uploaded_at")


@query("removable_masters", f"""WITH u AS ({UPLOADS} WHERE event_id % 3 = 0 OR event_type <> 'error'), m AS ({MASTERS})
 SELECT fingerprint FROM m WHERE fingerprint NOT IN (SELECT fingerprint FROM u WHERE NOT deleted)""")
def removable_masters(spark, folder):
    copies = _uploads(spark, folder).where(F.col("deleted") | ~F.col("filename").startswith("error"))
    return catalog.removable_masters(prepared(spark, folder, MASTERS), copies, "fingerprint", "deleted")


@query("upsert_latest", """WITH a AS (SELECT user_id, value, ts, 0 AS n, event_id FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, value, ts, 1 AS n, event_id FROM events WHERE event_type = 'purchase'),
c AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT user_id, arg_max(value, (ts, n)) AS value, max(ts) AS ts FROM c GROUP BY user_id""")
def upsert_latest(spark, folder):
    events = table(spark, folder, "events").select("user_id", "value", "ts", "event_type")
    current, changes = events.where("event_type <> 'purchase'").drop("event_type"), events.where("event_type = 'purchase'").drop("event_type")
    return catalog.upsert_latest(current, changes, "user_id", "ts")


@query("catalog_newest", f"""WITH u AS ({UPLOADS}) SELECT event_id, uploaded_at, filename FROM u ORDER BY uploaded_at DESC, event_id LIMIT 100""")
def catalog_newest(spark, folder):
    return catalog.newest_first(_uploads(spark, folder), "uploaded_at", "event_id").select("event_id", "uploaded_at", "filename")


@query("known_content", f"""WITH m AS (SELECT item_id, {_digest(['text'])} AS fingerprint FROM benchmark), d AS (SELECT {_digest(['text'])} AS fingerprint FROM documents)
SELECT item_id, fingerprint IN (SELECT fingerprint FROM d) AS known FROM m""")
def known_content(spark, folder):
    documents, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    seen = documents.select(catalog.row_fingerprint(documents, ["text"]).alias("fingerprint"))
    marked = items.select("item_id", catalog.row_fingerprint(items, ["text"]).alias("fingerprint"))
    old, new = catalog.known_content(marked, seen)
    return old.select("item_id", F.lit(True).alias("known")).unionByName(new.select("item_id", F.lit(False).alias("known")))
