import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from gridsight.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c\n\t'stéß漢🙂12.- ", max_size=60))
def test_words_as_the_library_does(text):
    import regex
    assert [i for w in regex.findall(public_tokenizers.PATTERN, text) for i in bpe.merge(w.encode(), RANKS)] == LIBRARY.encode_ordinary(text)


def test_very_long_word():
    word = "abc" * 40_000
    assert bpe.merge(word.encode(), RANKS) == LIBRARY.encode_ordinary(word)


@pytest.mark.parametrize("block", [1, 2000, 1 << 30])
def test_round_trip(spark, folder, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(-1, None), (-2, ""), (-3, "   \n\n  x"), (-4, "<|endoftext|>"), (None, "no key"), (-5, "same"), (-5, "same"), (-6, "word " * 30_000), (-7, "ß" * 5000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, ids int").repartition(3)
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_bytes=block, decoded="both"), RANKS).collect()
    assert all(r["both"] == r["decoded"] for r in got)
    key = lambda r: (str(r[0]), r[2])
    want = [(k, len(ids := LIBRARY.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for k, t in rows]
    assert sorted([(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got], key=key) == sorted(want, key=key)


def test_query(spark, folder):
    from gridsight.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in QUERIES["op4_byte_bpe"](spark, folder).collect():
        ids = LIBRARY.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN).count() == 0
