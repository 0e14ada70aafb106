import random
import re

from pyspark.sql import functions as F

from gridsight.llm import decision_lists as dl

SCHEMA = "doc_id bigint, text string, kept string, rule string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute_counts(text):
    text = text or ""
    blank = " \t\n\v\f\r"
    words = [w for w in re.split(f"[{blank}]+", text) if w]
    lines = [line for line in text.split("\n") if line.strip(blank)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(9)
    some = ["a", "b", "née", "日本語", "x|y", "#", "The", "end.", " ", " x"]
    out = [None, "", " \t\n\v\f\r ", "a", "a b", "a b c", "a b c a b c", "a a a a", "\n\nx\n x\nx\n\n", "x\r\nx\r\nx", "w " * 30_000, "line one\n" * 400,
           "abc" * 50_000, "p q r s p q r t", "𝒳𝒴 #𝒵"]
    out += ["".join(rng.choice(some) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["key"]: tuple(r[n] for n in names) for r in dl.measured(frame(spark, rows)).collect()}
    assert got == {i: brute_counts(t) for i, t in rows}


def test_colliding_hashes_of_windows_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(dl.F, "xxhash64", lambda *columns: F.lit(7).cast("bigint"))
    got = dl.measured(frame(spark, [(1, "a b c d e f a b c g"), (2, "a b c d")])).select("key", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == [(1, 6), (2, 0)]


def brute_list(rows, names, bins, precision, cover, most):
    """Sequential covering as a loop over the rows ``(values, bad, prune)``."""
    from math import log2
    cuts = {}
    for j, n in enumerate(names):
        values = sorted(r[0][j] for r in rows)
        at = [i / bins * (len(values) - 1) for i in range(1, bins)]
        cuts[n] = sorted({int((values[int(a)] + (values[min(int(a) + 1, len(values) - 1)] - values[int(a)]) * (a - int(a))) // 1) for a in at})
    holds = lambda rule, v: all((v[names.index(f)] > t) == above for f, above, t in rule)
    info = lambda b, g: log2(b / (b + g)) if b else 0.0
    rules, left = [], rows
    while len(rules) < most:
        rule = []
        while len(rule) < 4:
            now = [(v, bad) for v, bad, prune in left if not prune and holds(rule, v)]
            b0, g0 = sum(bad for _, bad in now), sum(not bad for _, bad in now)
            if not b0 or not g0:
                break
            best, chosen = 0.0, None
            for n in names:
                for t in cuts[n]:
                    for above in (False, True):
                        side = [bad for v, bad in now if (v[names.index(n)] > t) == above]
                        gain = sum(side) * (info(sum(side), len(side) - sum(side)) - info(b0, g0))
                        if gain > best + 1e-9:
                            best, chosen = gain, (n, above, t)
            if chosen is None:
                break
            rule.append(chosen)
        sides = []
        for n in range(1, len(rule) + 1):
            hit = [bad for v, bad, prune in left if prune and holds(rule[:n], v)]
            sides.append((sum(hit), len(hit) - sum(hit)))
        if not sides:
            break
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in sides]
        best = max(range(len(worth)), key=lambda i: (worth[i], -i))
        b, g = sides[best]
        if b < cover or b < precision * (b + g):
            break
        rules.append(tuple(rule[:best + 1]))
        left = [r for r in left if not holds(rules[-1], r[0])]
    return rules


def test_learned_list_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2500):
        a, b, c = rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 9)
        rows.append((i, a, b, c, ((a > 45 and b <= 20) or (c > 6 and a <= 30 and b > 35)) != (rng.random() < 0.01)))
    df = spark.createDataFrame(rows, "key bigint, a bigint, b bigint, c bigint, reject boolean")
    prune = {r["key"]: r["p"] for r in df.select("key", (F.pmod(F.xxhash64(F.lit("prune"), "key"), F.lit(3)) == 0).alias("p")).collect()}
    want = brute_list([((a, b, c), bad, prune[i]) for i, a, b, c, bad in rows], ["a", "b", "c"], 16, 0.8, 10, 16)
    got = dl.learn(df, ["a", "b", "c"], bins=16, precision=0.8)
    assert [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in got] == want and len(got) >= 2
    # The conditional expression gives the first rule that holds.
    judged = {r["key"]: r["n"] for r in df.select("key", dl.verdict(got).alias("n")).collect()}
    for i, a, b, c, _ in rows:
        values = {"a": a, "b": b, "c": c}
        first = next((k for k, rule in enumerate(got, 1) if all((values[x.feature] > x.threshold) == x.above for x in rule)), None)
        assert judged[i] == first


def test_nothing_to_learn(spark):
    schema = "key bigint, a bigint, reject boolean"
    for rows in ([], [(i, i, True) for i in range(50)], [(i, i, False) for i in range(50)], [(None, 1, True), (1, 2, None)],
                 [(i, 5, i % 2 == 0) for i in range(200)]):
        assert dl.learn(spark.createDataFrame(rows, schema), ["a"]) == []
    assert {r["n"] for r in spark.range(2).select(dl.verdict([]).alias("n")).collect()} == {None}


def test_query_rows_and_verdicts(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.sample(words, 80)) + (" ## ##" * 12 if i % 4 == 0 else "")) for i in range(400)]
    rows += [(1000, None), (1001, "too short"), (1002, "same three words " * 40), (None, rows[0][1]), (5, rows[5][1])]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400)] + [(1, None), (None, 0), (9999, 0)], "doc_id bigint, quality int")
    got = dl.judged(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[i]["kept"] == (i % 4 != 0) and not by[i]["base_failed"] for i in range(400))
    assert by[1002]["n_repeat_words"] == 120 and all(by[i]["base_failed"] and not by[i]["kept"] and by[i]["rule"] is None for i in (1000, 1001, 1002))
    assert not next(r for r in got if r["doc_id"] is None)["kept"]


def test_empty_table_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert dl.judged(frame(spark, []), labels).collect() == []
    row = dl.judged(frame(spark, [(1, " ".join(f"w{i}" for i in range(60)))]), labels).first()
    assert row["kept"] and not row["base_failed"]
