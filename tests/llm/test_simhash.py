import numpy as np
import xxhash

from gridsight.llm import simhash
from gridsight.llm.components import components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def check(spark, rows):
    got = {r["doc_id"]: (r["bits"] & (1 << 64) - 1, r["component_id"]) for r in
           simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, bits string").drop("x")).collect() if r["doc_id"] is not None}
    prints = {k: brute_print(t) for k, t, _ in rows if k is not None}
    assert {k: v[0] for k, v in got.items()} == prints
    assert {k: v[1] for k, v in got.items()} == brute_components(prints)


def test_documents(spark, folder):
    rows = [(r[0], r[1], "x") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"w{i}" for i in range(3000))
    rows += [(9000 + i, base + f" end{i}", "x") for i in range(20)]
    rows += [(9100, None, "x"), (9101, "", "x"), (9102, " \t\n", "x"), (9103, "one", "x"), (9104, "ONE", "x"), (9105, "a b c d e", "x"), (None, base, "x"), (9106, "q " * 70_000, "x")]
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_links_at_every_distance(spark):
    random = np.random.default_rng(3)
    base = random.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    near = np.concatenate([base ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), random.integers(0, 63, (300, flips))), axis=1) for flips in (1, 2, 3)])
    prints = np.unique(np.concatenate([base, near]))
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(int(p),) for p in prints], "bits bigint")).collect()}
    far = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64))
    want = {(int(prints[i]), int(prints[j])) for i, j in zip(*np.nonzero((far > 0) & (far <= 2))) if prints[i] < prints[j]}
    assert got == want and len(want) >= 500


def test_copies_at_anchors_are_not_broadcast(spark):
    prints = spark.createDataFrame([(i * 977,) for i in range(50)], "bits bigint")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 4999), (4999, 5000), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)} | {4999: 4999, 5000: 4999}
    assert got == want
