import re

import numpy as np
from hypothesis import given, settings, strategies as st

from gridsight.llm import decontaminate
from gridsight.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(item)
    result = []
    for key, text in docs:
        words = words_of(text)
        hit, found = [0] * len(words), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                own = windows.get(tuple(words[i:i + size]))
                if own is not None:
                    found |= own
                    hit[i:i + size] = [1] * size
        result.append((key, len(words), sum(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(result, key=str)


def run(spark, docs, items, **options):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    return decontaminate.find_passages(documents, benchmark, **options)


def test_planted_cases(spark):
    phrase = "One two THREE four-five six, seven eight nine ten eleven twelve"
    docs = [(1, f"before {phrase} after"), (2, None), (3, ""), (4, "one two three four five six seven eight nine"), (5, phrase.upper()),
            (6, "short item"), (7, "çà short  item! " * 50), (None, phrase), (1, f"{phrase} {phrase}"), (8, "x " * 20000 + phrase), (9, "... ,,, ")]
    items = [(10, phrase), (2, "Short item"), (3, None), (4, "!!"), (None, "x x x"), (11, phrase), (10, "other words"), (12, "çà short item çà")]
    found = run(spark, docs, items)
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()], key=str)
    assert got == brute(docs, items)
    assert all(sum(s["last"] - s["first"] for s in r["spans"]) == r["n_hit"] for r in found.collect())
    small_blocks = run(spark, docs, items, block_bytes=8).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in small_blocks], key=str) == got


def test_whole_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in run(spark, docs, items).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_empty_tables_and_carried_columns(spark):
    assert run(spark, [], [(1, "a b")]).count() == 0
    docs = spark.createDataFrame([(1, "a b", "kept", 7)], "doc_id bigint, text string, key string, n_hit int")
    none = spark.createDataFrame([], "item_id bigint, text string")
    row = decontaminate.find_passages(docs, none, carry=True).first()
    assert (row["n_hit"], row["key"], row["items"], row["spans"]) == (0, "kept", [], [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(1, 3), min_size=1, max_size=5))
def test_index_finds_all_places(symbols, phrase):
    text = np.array([0, *symbols, *symbols, 0], np.uint16)
    index = FMIndex(text, 4)
    row = np.zeros((1, 6), np.int64)
    row[0, :len(phrase)] = phrase
    low, high = index.search(row, np.array([len(phrase)]))
    want = [i for i in range(len(text)) if text[i:i + len(phrase)].tolist() == phrase]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want
