"""Trees of token, document and instance sources; inputs and expected values of the sampling and mixing cases are the fixture list's."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import sampling, trees

STREAMS = {"a": [*range(12)], "b": [*range(12, 24)], "c": [*range(100, 108)]}


def leaf(spark, *names, streams=STREAMS):
    return trees.leaves(spark.createDataFrame([(n, len(streams[n]), k) for k, n in enumerate(names)], "name string, tokens long, rank int"), "name", "tokens", "rank")


def tokens(spark, node, streams=STREAMS):
    plan = trees.plan(node)
    docs = spark.createDataFrame([(n, 0, len(x), x) for n, x in streams.items()], "leaf string, start long, end long, ids array<int>")
    rows = sampling.read_ranges(plan, docs, ["leaf"]).orderBy("index", "at").collect()
    out = [x for r in rows for x in r.ids]
    assert [r.offset + r["at"] for r in rows] == [sum(len(q.ids) for q in rows[:k]) for k in range(len(rows))]
    return out


def test_samples_of_mixtures_keep_their_shares(spark):
    mixed = trees.mix([(leaf(spark, "a"), 0.25, 1.0), (leaf(spark, "b"), 0.75, 1.0)], 16)
    assert tokens(spark, mixed) == [*range(4), *range(12, 24)]
    assert tokens(spark, trees.sample([mixed], 8)) == [0, 1, 12, 13, 14, 15, 16, 17]
    assert tokens(spark, trees.sample([mixed], 32)) == [*range(4)] * 2 + [*range(12, 24)] * 2


def test_samples_of_resized_sources(spark):
    up = trees.resized(leaf(spark, "c"), 1.5)
    c = STREAMS["c"]
    assert tokens(spark, up) == c + c[:4]
    assert tokens(spark, trees.sample([up], 9)) == c[:6] + c[:3]
    assert tokens(spark, trees.sample([up], 18)) == c + c[:4] + c[:4] + c[:2]


def test_what_is_concatenated_or_sliced_is_sampled_as_one(spark):
    both = trees.concat(leaf(spark, "a"), leaf(spark, "c"))
    assert tokens(spark, trees.sample([both], 15)) == [*range(12), 100, 101, 102]
    assert tokens(spark, trees.sample([both], 45)) == (STREAMS["a"] + STREAMS["c"]) * 2 + [*range(5)]
    cut = trees.sliced(both, 3, -2)
    assert tokens(spark, cut) == [*range(3, 12), *range(100, 106)]
    assert tokens(spark, trees.sample([cut, leaf(spark, "b")], 9)) == [3, 4, 5, 6, 7, 12, 13, 14, 15]
    assert tokens(spark, trees.sliced(trees.repeat(cut, 3), 12, 20)) == [103, 104, 105, *range(3, 8)]
    with pytest.raises(Exception, match="empty slice"):
        tokens(spark, trees.sliced(both, 5, 5))


def test_units_of_samples_come_after_others(spark):
    inner = trees.sample([leaf(spark, "a")], 6)
    assert tokens(spark, trees.sample([inner, leaf(spark, "c")], 7)) == [100, 101, 102, 103, 0, 1, 2]


def test_seeds_choose_runs_that_stay_inside(spark):
    node = trees.sample([leaf(spark, "a", "b"), trees.concat(leaf(spark, "c"))], 40, seed=5)
    rows = trees.plan(node).collect()
    assert all(0 <= r.start < r.end <= len(STREAMS[r.leaf]) for r in rows) and sum(r.end - r.start for r in rows) == 40
    assert sorted(map(tuple, rows)) == sorted(map(tuple, trees.plan(node).collect()))


def test_a_target_that_cannot_be_met_is_an_error(spark):
    with pytest.raises(Exception, match="Unable to meet target size"):
        tokens(spark, trees.mix([(leaf(spark, "a"), 0.5, 1.0), (leaf(spark, "b"), 0.5, 1.0)], 50))


def documents(spark, *texts, first=0):
    rows = [(first + k, len(x), x) for k, x in enumerate(texts)]
    return trees.rows_of(spark.createDataFrame(rows, "doc int, n int, ids array<int>"), ["doc"])


def ids(node):
    return [x for r in trees.numbered(node, {"end": "n"}).orderBy("index").collect() for x in r.ids]


@pytest.mark.parametrize("repetition", [1, 2])
def test_mixed_documents(spark, repetition):
    a = [[1, 1, 1, 0], [2, 2, 2, 0]]
    b = [[3, 3, 3, 0], [4, 4, 4, 0], [5, 5, 5, 0], [6, 6, 6, 0]]
    mixed = trees.mix_documents([(documents(spark, *a), 0.5, float(repetition)), (documents(spark, *b), 0.5, 1.0)])
    assert ids(mixed) == {1: sum(a, []) + sum(b[:2], []), 2: sum(a, []) + a[0] + sum(b[:3], [])}[repetition]


def test_sampled_documents_are_whole(spark):
    docs = documents(spark, [1, 1, 1, 1, 0], [2, 2, 2, 0], [3, 3, 0], [4, 0])
    assert ids(trees.sample_documents(docs, 13)) == [1, 1, 1, 1, 0, 2, 2, 2, 0, 3, 3, 0]
    assert ids(trees.sample_documents(docs, 20)) == [1, 1, 1, 1, 0, 2, 2, 2, 0, 3, 3, 0, 4, 0, 1, 1, 1, 1, 0]
    seeded = trees.numbered(trees.sample_documents(docs, 30, seed=1)).collect()
    assert {r.doc for r in seeded if r.copy == 0} == {0, 1, 2, 3} and sum(r.n for r in seeded) <= 30
    nested = trees.concat_rows(trees.sample_documents(docs, 9), documents(spark, [7, 0]))
    assert ids(trees.sample_documents(nested, 22)) == [1, 1, 1, 1, 0, 2, 2, 2, 0, 7, 0] * 2


def instances(spark, n, first):
    return trees.rows_of(spark.range(first, first + n), ["id"])


def picked(node):
    return [r.id for r in trees.numbered(node).orderBy("index").collect()]


def test_mixed_and_sampled_instances(spark):
    mixed = trees.mix_instances([(instances(spark, 8, 0), 0.5, 1.0), (instances(spark, 24, 8), 0.5, 1.0)], 8)
    assert picked(mixed) == [*range(8), *range(8, 16)]
    assert picked(trees.sample_instances([instances(spark, 8, 0), instances(spark, 8, 8)], 8)) == [*range(4), *range(8, 12)]
    assert picked(trees.sample_instances([instances(spark, 8, 0), instances(spark, 8, 8)], 24)) == [*range(8), *range(4), *range(8, 16), *range(8, 12)]
    assert picked(trees.sample_instances([instances(spark, 10, 0)], 7, chunk=4)) == [0, 1, 2, 3]
    seeded = picked(trees.sample_instances([mixed], 40, seed=2))
    assert len(seeded) == 40 and sorted(seeded)[::2] != seeded[::2] and all(seeded.count(i) in (2, 3) for i in range(16))
    with pytest.raises(Exception, match="Unable to meet target size"):
        picked(trees.mix_instances([(instances(spark, 8, 0), 0.5, 1.0), (instances(spark, 8, 8), 0.5, 1.0)], 8, target=150))


def test_random_trees_follow_a_plain_version(spark):
    rng = random.Random(7)
    names = [f"s{k}" for k in range(12)]
    streams = {n: [1000 * k + i for i in range(rng.randint(1, 30))] for k, n in enumerate(names)}
    flat = leaf(spark, *names, streams=streams)
    for most in (7, 100, 300):
        total = sum(map(len, streams.values()))
        want = []
        for n in names:
            w = round(most * (len(streams[n]) / total))
            want += streams[n] * (w // len(streams[n])) + streams[n][: w % len(streams[n])]
        assert tokens(spark, trees.sample([flat], most), streams) == want
    assert trees.plan(flat).agg(F.max("offset")).first()[0] == sum(len(streams[n]) for n in names[:-1])
