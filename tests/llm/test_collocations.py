import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from gridsight.llm import collocations as co

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n string, _part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\v\f\r]", low)]


def brute(rows, least=10, top=2000, longest=3):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = any(100 * b >= 50 * a for q, b in candidates.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def found(spark, rows, **options):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in co.collocations(frame(spark, rows), **options).collect())


def corpus(seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "ab", "née", "große", "x", "Y", "日本", "a#b"] + [f"w{i}" for i in range(25)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 12 + [". ", "\n", ",", "\t ", "; "]) for _ in range(n))
    shared = text(300)
    rows = [(i, text(rng.randint(0, 200)) + (shared if i % 4 == 0 else ""), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    # Copies, one word again and again, blanks only, null, and a text without any break.
    rows += [(100 + i, shared, "en") for i in range(12)] + [(200, "again " * 5000, "en"), (201, " \t", "en"), (202, None, "de"), (203, "", None), (203, "z" * 100_000, "fr")]
    return rows


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 5, "top": 40}, {"longest": 2}])
def test_against_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(co, "CHUNK_WORDS", 64)
    rows = corpus()
    want = brute(rows, options.get("least", 10), options.get("top", 2000), options.get("longest", 3))
    assert len(want) > 60 and found(spark, rows, **options) == want


def test_crowded_buckets_change_no_count(spark, monkeypatch):
    rows = corpus(5)[:70]
    want = found(spark, rows)
    monkeypatch.setattr(co, "FILTER_BITS", 9)
    monkeypatch.setattr(co, "GROUP_BITS", 3)
    assert found(spark, rows) == want == brute(rows)


def test_chunks_rebuild_texts_and_equal_passages_share_them():
    passage = " ".join(f"p{i % 97}x{i}" for i in range(800))
    texts = [passage, "other words before . " + passage, "", "one", " two. three"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(texts)], ["lang", "text"])
    chunks = co.parse(batch, 2).to_pylist()
    words = [w for t in texts for p in pieces(t) for w in p]
    own = [w for c in chunks for w in re.split(r"[ \n]", c["chunk"])[:c["words"]]]
    assert own == words and all(c["overlap"] <= 2 for c in chunks)
    # A chunk goes on for two words of the next, unless its piece ends.
    spread = [re.split(r"[ \n]", c["chunk"]) for c in chunks]
    assert all(s[-c["overlap"]:] == t[:c["overlap"]] for s, t, c in zip(spread, spread[1:], chunks) if c["overlap"])
    distinct = Counter(c["chunk"] for c in chunks)
    assert sum(1 for c in distinct.values() if c == 2) >= len(distinct) - 8 > 5


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 6 * 10**12), ("en", "a", 1, 9 * 10**12), ("en", "b", 1, 8 * 10**12)], "lang string, phrase string, words int, f bigint")
    sizes = spark.createDataFrame([("en", 10**14)], "lang string, n bigint")
    row = co.ranked(counts, sizes, 2, 2000, 50).first()
    assert row["score"] == 1_000_000 * 36 * 10**24 // (72 * 10**24) and (row["l"], row["r"], row["n"]) == (9 * 10**12, 8 * 10**12, 10**14)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert co.collocations(frame(spark, [(1, None, None), (2, " ", "en")])).count() == 0
