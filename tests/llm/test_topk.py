import math
import random

import numpy as np
import pytest

from millrace.llm import topk

SCHEMA = "label string, vec_id long, embedding array<float>, score int"


def brute(rows, k=5):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in whole if i is not None and i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in whole if j != i)[:k]
        out |= {(i, q, n + 1, None if lost else j, -s) for n, (s, lost, j) in enumerate(found)}
    return sorted((i, n, -1 if j is None else j, s) for i, _, n, j, s in out)


def run(spark, rows):
    df = spark.createDataFrame([("x", i, v, 0) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r.rank, -1 if r.vec_id is None else r.vec_id, r.score) for r in topk.top_k(df).collect())


def vectors(n, wide=9, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(wide)]) for i in range(n)]


def test_matches_brute_force(spark, monkeypatch):
    rows = vectors(700)
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(topk, "LEAST", 2)
    monkeypatch.setattr(topk, "PART", 3)
    monkeypatch.setattr(topk, "LANE", 1)
    many = rows + [(i + 1000, v) for i, v in vectors(100, seed=5, spread=40.0)]
    assert run(spark, many) == brute(many)


def test_ties_nulls_lengths_and_repeated_rows(spark):
    one = [1.0, -2.0, 0.5]
    rows = [(i, one) for i in range(0, 120)] + [(7, one), (50, one), (50, [0.0, 0.0, 0.0]), (None, one), (None, [9.0, -9.0, 9.0]), (200, None), (250, [1.0, None, 2.0]), (300, [1.0, float("nan"), 2.0]), (301, [1.0, float("inf"), 2.0]), (350, []), (400, [3.0]), (450, [-1.0, -1.0, -1.0, 7.0, -3.0])]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == [] and run(spark, []) == []


def test_very_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(0, [1.0]), (1, [1e9])])


def test_planes_hold_exact_scores():
    rng = np.random.default_rng(0)
    numbers = rng.integers(-(1 << 20), 1 << 20, (200, 6))
    slices, digits = topk.sliced(numbers)
    both = np.stack([slices, ~slices])
    for weights in (rng.integers(-(1 << 20), 1 << 20, 6), np.zeros(6, int), np.array([0, 0, -5, 0, 0, 0])):
        planes, high = topk.scores(both, digits, weights)
        value = sum((np.unpackbits(p.view(np.uint8), bitorder="little")[:200].astype(np.int64) << n for n, p in enumerate(planes)), np.zeros(200, np.int64)) - high
        assert (value == numbers @ weights).all()


def test_best_selects_the_rows_from_the_kth_on():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 50, 128), np.zeros(128, int), np.arange(128)):
        planes = [np.packbits((values >> j & 1).astype(np.uint8), bitorder="little").view("<u8") for j in range(8)]
        alive = rng.integers(0, 2, 128).astype(np.uint8)
        for k in (1, 5, 200):
            got = np.flatnonzero(np.unpackbits(topk.best(planes, np.packbits(alive, bitorder="little").view("<u8"), k).view(np.uint8), bitorder="little"))
            live = np.flatnonzero(alive)
            least = sorted(values[live])[-k] if k <= len(live) else -1
            assert got.tolist() == [i for i in live if values[i] >= least]
