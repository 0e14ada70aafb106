"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridsight.functions.scale import saved
from gridsight.llm import bpe, codes, collocations, decision_lists, decontaminate, language, licenses, merkle, quality, rollups, simhash, warc, wrappers
from gridsight.queries.registry import table

QUERIES = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql.strip()
        return function
    return add


@_query("op1_html_wrappers")
def html_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    found = wrappers.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BASES = """CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
            WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END"""
# The templates as regular expressions over the words of a text, each with a space before and after it.
_NOTICES = {
    "mit-notice": "(released|licensed) under the (terms of the )?mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                "(the software )?to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-2.0": "licensed under the (terms of the )?(gnu )?general public license version 2",
    "gpl-3.0": "licensed under the (terms of the )?(gnu )?general public license version 3",
    "gpl-text": "under the terms of the gnu general public license as published by the free software foundation",
    "cc-by-4.0": "licensed under (a )?(the )?cc by 4 0",
    "cc-by-nc-4.0": "licensed under (a )?(the )?cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under (a )?(the )?cc by sa 4 0",
    "cc-named": "licensed under (a )?(the )?creative commons attribution ([^ ]+ ){0,3}license",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                "conditions are met",
    "isc-text": "permission to use copy modify (and )?(or )?distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "spdx": "spdx license identifier [^ ]+",
    "rights-reserved": "copyright (c )?([^ ]+ ){1,8}all rights reserved",
}
_NOTICE_SQL = ", ".join(f"CASE WHEN regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' {p} ') THEN '{n}' END" for n, p in _NOTICES.items())


@_query("op2_license_templates", f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT *, list_filter(list_transform(range(1, len(w)), lambda i: {{'at': i - 1, 'label': {_BASES}}}), lambda x: x.label IS NOT NULL) AS p,
                  list_filter([{_NOTICE_SQL}], lambda n: n IS NOT NULL) AS notices FROM words),
found AS (SELECT *, list_transform(p, lambda x: x.label) AS bases FROM places)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word,
       CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(bases)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(bases, notices))), ',') AS labels,
       CASE WHEN len(notices) > 0 THEN 1.0::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM found""")
def license_templates(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    bases, notices = F.col("bases.label"), F.col("matches.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select("doc_id", "n_words", F.size("bases").cast("bigint").alias("n_base"), F.array_min("bases.first").alias("first_word"),
                        F.array_max("bases.first").alias("last_word"), joined(bases).alias("base_labels"), joined(F.concat(bases, notices)).alias("labels"),
                        F.when(F.size("matches") > 0, 1.0).when(F.size("bases") > 0, 0.5).otherwise(0.0).alias("score"))


@_query("op3_warc_members", """
WITH sums AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM sums)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           ((CAST('0x' || substr(h, 1 + 5 * (j // 4), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM firsts""")
def warc_members(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, folder, "pages")), payloads=False)
    return found.select(warc.page_of("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        warc.page_of("refers_to").cast("bigint").alias("refers_to"))


def token_digests(documents: DataFrame) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = bpe.encode(documents, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))


@_query("op5_merkle_fingerprints")
def merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = merkle.following(table(spark, folder, "documents")).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    found = merkle.compare(rows.withColumn("edited", edited), "text", ["edited", "next_text"])
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("text_root").alias("fingerprint"),
                        F.col("edited_root").alias("edited_fingerprint"), F.col("edited_likeness").alias("near_edited"),
                        F.col("next_text_likeness").alias("near_next"))


@_query("op6_token_rollups", """
WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
kept AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS n FROM texts),
counts AS (SELECT source, lang, 'space-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_tokens FROM kept WHERE n = 1
           UNION ALL SELECT source, lang, 'bytes-1', strlen(t) FROM kept WHERE n = 1)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM counts GROUP BY source, lang, tokenizer""")
def token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """First counts are estimates, the second batch revises them and adds a version, the third deletes copies of texts."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("key"), "source", "lang", (F.col("n_chars") / 6).cast("bigint").alias("guess"), F.sha2(text, 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"), F.octet_length(text).cast("bigint").alias("bytes"))
    docs = saved(docs)
    change = lambda rows, op, tokenizer, count: rows.select(
        "key", F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("n_tokens"))
    first = saved(docs.groupBy("digest").agg(F.min("key").alias("first")))
    copies = docs.join(first, "digest").filter("key <> first")
    exact = change(docs, "insert", "space-1", "words").unionByName(change(docs, "insert", "bytes-1", "bytes"))
    ledger = rollups.TokenLedger(spark)
    ledger.commit("estimates", change(docs, "insert", "space-1", "guess"))
    ledger.commit("exact", exact)
    ledger.commit("exact", exact)
    ledger.commit("copies", change(copies, "delete", "space-1", "words").unionByName(change(copies, "delete", "bytes-1", "bytes")))
    return ledger.totals()


@_query("op7_simhash_anchors")
def simhash_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def languages(documents: DataFrame) -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` of a model learned from their own held-in rows."""
    model = language.fit(documents, ~language.held_out(F.col("doc_id"), 5, 0))
    return language.predict(documents, model)


@_query("op8_ftrl_language_id")
def ftrl_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = languages(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", language.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def qualities(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``score`` and ``predicted`` of a model learned from held-in labels."""
    model = quality.fit(documents, labels, ~language.held_out(F.col("doc_id"), 4, 2))
    return quality.predict(documents, model)


@_query("op9_additive_quality")
def additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = qualities(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return found.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


@_query("op10_fm_index_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w, least(10, len(w)) AS l FROM benchmark),
bi AS (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM b WHERE l > 0), bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw)), dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM di),
hits AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, g)), places AS (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM hits),
covered AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""")
def fm_index_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query("op11_phrase_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT id, lang, unnest(w) AS x, unnest(range(len(w))) AS i FROM words),
runs AS (SELECT lang, x, lead(x) OVER ahead AS y, lead(x, 2) OVER ahead AS z FROM places WINDOW ahead AS (PARTITION BY id ORDER BY i)),
phrases AS (SELECT lang, 1 AS k, x AS phrase FROM runs UNION ALL SELECT lang, 2, x || ' ' || y FROM runs WHERE y IS NOT NULL
            UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM runs WHERE z IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY lang, k, phrase),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, c.f AS a, l.f AS l, r.f AS r, cut, CAST((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
         FROM candidates c JOIN (VALUES (1), (2)) AS t(cut) ON cut < c.k
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE k = 3) x
           GROUP BY lang, part),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer ON s.lang = longer.lang AND s.phrase = part WHERE part IS NULL OR 100 * longer.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""")
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.collocations(table(spark, folder, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _codebook_sql(rounds: int = 6) -> str:
    """Each round of the codebooks as two tables: the parts' nearest entries, and the entries' means."""
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for number in range(rounds + 1):
        steps.append(f"""near{number} AS MATERIALIZED (SELECT p.id, p.part, p.v, b.entry, {distance} AS d FROM parts p JOIN book{number} b USING (part)
  QUALIFY row_number() OVER (PARTITION BY p.id, p.part ORDER BY {distance}, b.entry) = 1)""")
        if number < rounds:
            steps.append(f"""mean{number} AS (SELECT part, entry, list(m ORDER BY place) AS v FROM (SELECT part, entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(8)) AS place FROM near{number}) GROUP BY part, entry, place) GROUP BY part, entry),
book{number + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{number} b LEFT JOIN mean{number} m USING (part, entry))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 4096) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, part, v[8 * part + 1:8 * part + 8] AS v FROM kept, range(8) AS t(part)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, v FROM parts WHERE id <= 16),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds}),
coded AS (SELECT id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (id), digest"""


@_query("op12_vector_codes", _codebook_sql())
def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@_query("op13_decision_rules")
def decision_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = decision_lists.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
