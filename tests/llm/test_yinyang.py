import hashlib
import math
import random

import numpy as np

from millrace.llm import yinyang

SCHEMA = "cluster string, vec_id long, embedding array<float>, distance int"


def brute(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centers)):
            mine = [v for (_, v), c in zip(kept, own) if c == n]
            if mine:
                centers[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [nearest(v) for _, v in kept]
    inertia = {n: sum(d for d, c in found if c == n) for n in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found))


def run(spark, rows, **settings):
    df = spark.createDataFrame([("x", i, v, 0) for i, v in rows], SCHEMA)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in yinyang.cluster(df, **settings).collect())


def vectors(n, size, seed=1):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(heads)]) for i in range(n)]


def test_matches_brute_force(spark, monkeypatch):
    rows = vectors(400, 6)
    assert run(spark, rows, size=6) == brute(rows, size=6)
    monkeypatch.setattr(yinyang, "ROWS", 50)
    odd = rows + [(7, rows[3][1]), (None, rows[9][1]), (900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [1.0] * 5 + [float("-inf")]), (905, [1.0] * 7), (906, [])]
    assert run(spark, odd, size=6, k=13, group=3) == brute(odd, size=6, k=13)


def test_ties_copies_and_few_rows(spark):
    copies = [(i, [1.0, 2.0]) for i in range(60)] + [(i, [3.0, 2.0]) for i in range(60, 63)]
    assert run(spark, copies, size=2) == brute(copies, size=2)
    few = [(4, [0.5, 0.25]), (5, [-0.5, 0.25]), (6, [0.0, 0.25])]
    assert run(spark, few, size=2) == brute(few, size=2)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_bounds_give_exact_assignments_and_save_distances():
    rng = np.random.default_rng(2)
    heads = rng.integers(-2000, 2000, (24, 16))
    x = heads[rng.integers(0, 24, 5000)] + rng.integers(-60, 60, (5000, 16))
    centers = x[rng.choice(5000, 24, replace=False)]
    groups = yinyang.grouped(centers, 6)
    assert sorted(np.concatenate(groups).tolist()) == list(range(24))
    state, moved, scanned = None, None, []
    for _ in range(12):
        own, upper, lower, n = yinyang.assign(x, centers, groups, moved, state)
        exact = ((x[:, None] - centers[None]) ** 2).sum(2)
        assert (own == exact.argmin(1)).all()
        state, scanned = (own, upper, lower), [*scanned, n]
        means = np.stack([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else centers[c] for c in range(24)])
        moved = np.sqrt(((means - centers) ** 2).sum(1).astype(float)) * (1 + 1e-12)
        centers = means
    assert scanned[0] == 24 * 5000 and sum(scanned[1:]) < 11 * 24 * 5000 / 3


def test_distances_beyond_doubles_are_exact():
    x, c = np.array([[1 << 24, -(1 << 24)] * 32]), np.array([[-(1 << 24), (1 << 24) - 1] * 32])
    assert yinyang.squared(x, c)[0, 0] == sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], c[0]))
