import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import neardup


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(texts):
    """Smallest id of each component, all pairs compared."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize("small", [16, 2])
def test_pipeline_stage_links_all_pairs_of_similarity_08(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    line, texts = make(12), [None, "", "a b", "A  b", "a c"]
    for n in (20, 60, 200):
        for _ in range(3):
            base = make(n) + line
            for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(len(t))] = "edit"
                texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept(texts)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == want
    assert len(want) < len(set(texts)) - 20  # most near copies aren't equal


@pytest.mark.parametrize("patience, deepest", [(1e9, 4), (1e9, 2), (0, 1)])
def test_buckets_dealt_by_further_shingles(spark, monkeypatch, patience, deepest):
    """Texts put together of few lines in one order: all shingles are frequent, and most texts that share some aren't similar."""
    for name, n in (("SMALL", 2), ("PATIENCE", patience), ("DEEPEST", deepest)):
        monkeypatch.setattr(neardup, name, n)
    dealt, further = [], neardup.further
    monkeypatch.setattr(neardup, "further", lambda rows, sets, shared, depth: dealt.append(depth) or further(rows, sets, shared, depth))
    rng = random.Random(7)
    lines = [" ".join(f"l{i}w{j}" for j in range(rng.choice([3, 6, 9, 30]))) for i in range(14)]
    texts = [" ".join(line for line in lines if rng.random() < rng.choice([0.4, 0.9])) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept(texts)
    assert {r.doc_id for r in neardup.deduplicate(docs).collect()} == want
    assert dealt == list(range(1, deepest)) and 1 < len(want) < 300


def test_rows_that_meet_again_over_batches():
    """Of rows sorted by token and node, whatever their batches: one each of those whose token has more than one node."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        rows = sorted(zip(rng.integers(0, 12, n).tolist(), rng.integers(0, 4, n).tolist()))
        salt = {t: int(t == 5) for t, _ in rows}
        nodes = {t: {x for u, x in rows if u == t} for t, _ in rows}
        want = sorted({r for r in rows if len(nodes[r[0]]) > 1 or salt[r[0]]})
        cuts = sorted(rng.integers(0, n + 1, 4).tolist())
        batches = []
        for a, b in zip([0, *cuts], [*cuts, n]):
            some = rows[a:b]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([9] * len(some), pa.int32()), pa.array([0] * len(some), pa.int32()), pa.array([salt[r[0]] for r in some], pa.int32())], ["token", "node", "n", "pos", "salt"]))
        got = [(t, x) for b in neardup.met_again(iter(batches)) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert got == want


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a b", 3), (3, "a b", 4), (None, "a b", 5), (7, "word " * 60_000, 6), (8, "word " * 60_001, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long")
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r._row for r in kept.collect())[0] == 1
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7]
    assert neardup.deduplicate(df.limit(0)).count() == 0


def test_bitmaps_rule_out_no_similar_pair(monkeypatch):
    """Bitmaps, of different widths too, of blocks with all pairs compared: what is left holds every pair that is similar."""
    monkeypatch.setattr(neardup, "WORDS_AT_ONCE", 100)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = []
    for n in (14, 15, 16, 17, 30, 33, 120, 128, 129, 140, 250, 260):
        for drop in (0, 1, 2, 4, 9):
            keep = rng.random(n) >= drop / 40
            sets.append(np.unique(np.append(base[:n][keep], rng.integers(0, 1 << 63, drop).astype(np.uint64))))
    part = np.arange(len(sets)) % 2
    for x, y in ((0, 0), (0, 1), (1, 1)):
        own = [i for i in range(len(sets)) if part[i] in (x, y)]
        rows = pa.table({"x": [x] * len(own), "y": [y] * len(own), "part": part[own], "node": own, "root": own, "n": [len(sets[i]) for i in own], "pos": [0] * len(own), "bits": [neardup.bitmap(sets[i]).tobytes() for i in own]})
        got = neardup.near_bitmaps(rows, 1)
        got = list(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
        want = {(i, j) for i in own for j in own if i < j and (part[i], part[j]) in ((x, y), (y, x)) and similar(set(sets[i].tolist()), set(sets[j].tolist()))}
        assert len(got) == len(set(got)) and want and want <= set(got)
        assert len(got) < len(own) ** 2 / 5


def test_large_buckets_of_sets_that_are_not_similar_make_few_rows(spark, monkeypatch):
    """Texts of one template, each with other edits: no row of further shingles, no pair of sets that bitmaps rule out."""
    made, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "further", None)
    monkeypatch.setattr(neardup, "verified", lambda pairs, sets: made.append(pairs.count()) or verified(pairs, sets))
    for name, n in (("SMALL", 2), ("WIDE", 16)):
        monkeypatch.setattr(neardup, name, n)
    rng = random.Random(4)
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(120):
        t = list(base)
        for k in rng.sample(range(150), rng.choice([1, 3, 6, 6, 6])):
            t[k] = f"edit{rng.random()}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept(texts)
    assert {r.doc_id for r in neardup.deduplicate(docs).collect()} == want and 20 < len(want) < 110
    assert sum(made) < 120 * 119 / 2
