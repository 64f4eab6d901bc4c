import hashlib
import math
import random

import numpy as np
import pytest

from rulewright.llm import centroids

WIDE = "vec_id long, embedding array<float>, cluster int, weight int, key1 int"


def expected(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers] for _, v in kept]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centers)):
            mine = [v for (_, v), (x, _) in zip(kept, at) if x == c]
            if mine:
                centers[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    inertia = {c: sum(d for x, d in at if x == c) for c in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (c, d) in zip(kept, at)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,kinds", [(0, 1), (3, 3), (5, 1), (400, 25), (300, 300)])
def test_matches_plain_python(spark, n, kinds):
    """Copies up to a third of all rows, repeated and null ids, rows to leave out, ties, negative parts."""
    rng = random.Random(n)
    made = [[rng.choice([rng.gauss(0, 0.3), 0.25, -0.0001]) for _ in range(64)] for _ in range(kinds)]
    rows = [(rng.choice([i, i, i // 2]), made[0] if i % 3 == 0 else made[i % kinds]) for i in range(n)]
    bad = [(-1, None), (-2, []), (-3, [0.0] * 63), (-4, [0.0] * 65), (-5, [float("nan")] + [0.0] * 63), (-6, [0.0] * 63 + [float("-inf")]), (-7, [None] + [0.0] * 63)]
    rows += bad + ([(None, made[0])] if n else [])
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], WIDE)
    assert got(centroids.cluster(df)) == expected(rows)


def test_shuffled_vectors_and_few_broadcast_ones(spark, monkeypatch):
    """Both ways of joining back give the same rows."""
    rng = random.Random(1)
    made = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    rows = [(i, made[0] if i % 3 else made[i % 40]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = got(centroids.cluster(df))
    monkeypatch.setattr(centroids, "HEAVY", 3)
    assert got(centroids.cluster(df)) == whole and len(whole) == 200


def test_too_large_a_component_is_an_error(spark):
    df = spark.createDataFrame([(1, [3e30] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        centroids.cluster(df)
