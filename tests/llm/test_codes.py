import hashlib

import numpy as np
import pytest

from gridsight.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], c) for i, v, c in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(assign(v, p)[1], []).append(cut(v, p))
            new.append([[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    found = [(i, "".join(f"{assign(v, p)[1]:02x}" for p in range(parts)), sum(assign(v, p)[0] for p in range(parts)), c) for i, v, c in kept]
    sums = {}
    for _, _, e, c in found:
        sums[c] = sums.get(c, 0) + e
    return sorted(((i, s, e, sums[c], digest) for i, s, e, c in found), key=str)


def found(spark, rows, **options):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compress(frame(spark, rows), **options).collect()), key=str)


def vectors(n, seed, size=16):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=size).astype(np.float32)], None if i % 9 == 0 else 0 if i % 3 == 0 else i % 50) for i in range(n)]
    return rows


def test_against_brute_force(spark):
    rows = vectors(400, 1)
    # Dropped vectors, copies, repeated and missing keys.
    rows += [(-5, None, 1), (-4, [None] + [0.0] * 15, 1), (-3, [float("nan")] + [0.0] * 15, 2), (-2, [float("inf")] + [0.0] * 15, 2)]
    rows += [(1000 + i, rows[7][1], 7) for i in range(60)] + [(3, rows[9][1], 1), (3, rows[9][1], 1), (None, rows[11][1], None)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("count", [1, 5, 17])
def test_few_rows_and_ties(spark, count):
    rows = [(i, [float(i % 4)] * 8, i % 2) for i in range(count)]
    assert found(spark, rows) == brute(rows)


def test_search_equals_comparing_all():
    rng = np.random.default_rng(2)
    for width, reach in ((1, 3), (8, 4), (8, 10**6), (16, 2)):
        entries = rng.integers(-reach, reach, (16, width))
        parts = np.concatenate([rng.integers(-2 * reach, 2 * reach, (500, width)), entries])
        distance = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, best = codes.nearest(parts, entries)
        assert (best == distance.min(axis=1)).all() and (index == distance.argmin(axis=1)).all()


def test_empty_and_refused_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame(spark, [(1, [0.0] * 9, 1)]))
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)]))
    with pytest.raises(ValueError, match="too large"):
        codes.compress(frame(spark, [(1, [1e30] * 8, 1)]))
