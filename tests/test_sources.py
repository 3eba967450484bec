"""Streams of ids in parts: written by many tasks, pruned, and cut into documents where they start."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals, sampling, sums
from millrace.sources import shards, sink


def rows(seed=1, hot=400):
    rng = random.Random(seed)
    sizes = {"hot": hot, "small": 12, "one": 1}
    return [(s, k * 7 - 20, [rng.randint(1, 60_000) for _ in range(rng.randint(0, 9))] + [0]) for s, n in sizes.items() for k in range(n)]


def test_a_hot_source_is_written_in_parts_by_many_tasks(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "source string, doc_id long, ids array<int>").repartition(5)
    folder = str(tmp_path / "out")
    written = {r.source: r.tokens for r in sink.write_tokens(df, "source", "doc_id", folder, "u2", part=64).collect()}
    want = {s: [x for t, _, ids in sorted(data) if t == s for x in ids] for s in written}
    assert written == {s: len(x) for s, x in want.items()}
    found = shards.by_folder(shards.listed(spark, folder))
    assert [n for n, _ in found] == ["hot", "one", "small"] and len(found[0][1]) > 10 and all(size <= 2 * (64 + 10) for _, size in found[0][1])
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    ranges = shards.token_ranges(spark, [parts for _, parts in found], "u2", 50)
    for k, (name, _) in enumerate(found):
        got = ranges.where(F.col("path_idx") == k).orderBy("chunk_start").collect()
        assert [x for r in got for x in r.ids] == want[name] and [r.follows for r in got] == [*(want[name][r.chunk_start + 50] for r in got[:-1]), None]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    data = [("a", k, [k % 100] * 5) for k in range(200)] + [("b", 1, [70_000])]
    df = spark.createDataFrame(data, "source string, doc_id long, ids array<int>")
    with pytest.raises(Exception, match="don't fit"):
        sink.write_tokens(df, "source", "doc_id", str(tmp_path / "out"), "u2", part=64)
    assert [*(tmp_path / "out").rglob("*")] == []


def test_parts_with_a_gap_are_not_committed(tmp_path):
    writer = sink._Writer(str(tmp_path / "out"), "u2")
    with pytest.raises(ValueError, match="side by side"):
        writer.commit([sink.Parts([("a", 0, 3, "x")]), None, sink.Parts([("a", 4, 3, "y")])])


def test_filters_choose_the_ranges_that_are_read(spark, tmp_path):
    for k in range(3):
        np.arange(1000, dtype=np.uint32).tofile(tmp_path / f"{k}.npy")
    files = shards.listed(spark, str(tmp_path))
    ranges = shards.token_ranges(spark, files, "u4", 10)
    count = lambda df: df.rdd.getNumPartitions()
    assert count(ranges) == 300
    for where, n in (("path_idx = 1", 100), ("path_idx in (0, 2) and chunk_start < 50", 10), ("chunk_start >= 500 and chunk_start <= 510 and path_idx >= 1", 4), ("chunk_start = 30", 3), ("chunk_start > 980", 3), ("path_idx = 7", 0)):
        kept = ranges.where(where)
        assert count(kept) == max(n, 1) and kept.count() == n, where  # none is an empty task
    cut = shards.token_slices(spark, files, "u4", 995, 2000, 10)
    assert count(cut) == 3 and sorted((r.path_idx, r.at, r.ids) for r in cut.collect()) == [(k, 995, [995, 996, 997, 998, 999]) for k in range(3)]
    assert count(shards.token_slices(spark, files, "u4", 25, 45, 10)) == 9
    assert shards.token_slice(spark, *files[0], "u4", 998, 5000).first().ids == [998, 999]


def test_a_task_reads_many_ranges(spark, tmp_path):
    np.arange(1000, dtype=np.uint32).tofile(tmp_path / "0.npy")
    files = shards.listed(spark, str(tmp_path))
    ranges = shards.token_ranges(spark, files, "u4", 10, task=80)
    assert ranges.rdd.getNumPartitions() == 13 and ranges.where("chunk_start >= 900").rdd.getNumPartitions() == 2
    assert sorted((r.chunk_start, r.ids, r.follows) for r in ranges.collect()) == [(i, [*range(i, i + 10)], i + 10 if i < 990 else None) for i in range(0, 1000, 10)]
    got = shards.token_documents(spark, files, "u4", 500, chunk=10, task=80).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 501), (501, 1000)]


def brute(ids, end, begin, close, most, strategy):
    ends = [i + 1 for i, x in enumerate(ids) if x == end and (begin is None or i + 1 == len(ids) or ids[i + 1] == begin)]
    ends += [len(ids)] if close and ids and (not ends or ends[-1] != len(ids)) else []
    docs = list(zip([0, *ends], ends))
    if most and strategy == "truncate":
        docs = [(a, min(b, a + most)) for a, b in docs]
    elif most:
        docs = [(s, min(s + most, b)) for a, b in docs for s in range(a, b, most)]
    return docs


@pytest.mark.parametrize("chunk", [1, 3, 8, 1000])
def test_documents_start_where_their_task_is(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    streams = [[rng.choice([0, 5, 6, 7, 8, 9, 9, 9]) for _ in range(n)] for n in (0, 1, 40, 90)] + [[9] * 30, [0] * 6, [9] * 7 + [0], [0, 5, 0, 0, 5, 9, 0]]
    files, masks = [], []
    for k, ids in enumerate(streams):
        cuts = sorted({0, len(ids), *(rng.randint(0, len(ids)) for _ in range(3))})
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            np.array(ids[a:b], np.uint16).tofile(tmp_path / f"{k}-{a:03}.npy")
            parts.append((str(tmp_path / f"{k}-{a:03}.npy"), 2 * (b - a)))
        (np.array(ids) != 9).tofile(tmp_path / f"{k}.mask")
        files.append(parts)
        masks.append((str(tmp_path / f"{k}.mask"), len(ids)))
    for begin, close, most, strategy in ((None, True, None, "truncate"), (None, False, 4, "truncate"), (5, True, None, "truncate"), (5, False, 3, "fragment"), (None, True, 2, "fragment")):
        got = sorted(shards.token_documents(spark, files, "u2", 0, begin, close, most, strategy, masks, chunk).collect())
        want = [(k, a, b) for k, ids in enumerate(streams) for a, b in brute(ids, 0, begin, close, most, strategy)]
        assert [(r.path_idx, r.start, r.end) for r in got] == sorted(want), (begin, close, most, strategy)
        assert all(r.ids == streams[r.path_idx][r.start : r.end] and r.mask == [int(x != 9) for x in r.ids] and r.n == len(r.ids) for r in got)
    with pytest.raises(Exception, match="differ in length"):
        shards.token_documents(spark, files, "u2", 0, masks=[(p, n + 1) for p, n in masks]).collect()


def test_instances_of_ranges(spark, tmp_path):
    np.arange(103, dtype=np.uint16).tofile(tmp_path / "a.npy")
    np.arange(7, dtype=np.uint16).tofile(tmp_path / "b.npy")
    files = shards.listed(spark, str(tmp_path))
    got = sorted((r.path_idx, r.instance, r.input_ids) for r in shards.range_instances(shards.token_ranges(spark, files, "u2", 16), 8).collect())
    assert got == [(0, k, [*range(8 * k, 8 * k + 8)]) for k in range(12)]
    with pytest.raises(Exception, match="cut instances"):
        shards.range_instances(shards.token_ranges(spark, files, "u2", 12), 8).collect()


def test_values_meet_intervals_by_key(spark):
    rng = random.Random(3)
    held = []
    for by in ("a", None):
        at = -(1 << 40)
        for k in range(60):
            low = at + rng.choice([0, 1, 5, 1 << 33])
            at = low + rng.choice([1, 2, 900, 1 << 35])
            held.append((by, low, at - 1, k))
    asked = [(by, x) for by in ("a", None, "b") for _, low, last, _ in held[:60] for x in (low - 1, low, (low + last) // 2, last, last + 1)]
    df = spark.createDataFrame(asked, "by string, x long")
    found = intervals.within(df, "x", spark.createDataFrame(held, "by string, low long, last long, k int"), ["by"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((str(b), x, k) for b, x in asked for c, low, last, k in held if b == c and low <= x <= last)
    assert sorted((str(r.by), r.x, r.k) for r in found.collect()) == want


def test_locate_among_a_million_sources(spark):
    sources = spark.range(1_000_000).select(F.format_string("s%07d", "id").alias("source"), (F.col("id") % 4).alias("size"))
    found = sampling.locate(spark.range(0, 1_500_000, 1009).withColumnRenamed("id", "index"), "index", sources, ["source"])
    ends = np.cumsum(np.arange(1_000_000) % 4)
    for r in found.collect():
        k = int(np.searchsorted(ends, r["index"], "right"))
        assert (r.source, r.local) == (f"s{k:07d}", r["index"] - (ends[k] - k % 4))
    assert found.count() == len(range(0, 1_500_000, 1009))


def test_sums_over_sparse_orders_are_spread(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab") if i % 3 else None, rng.randrange(-(1 << 63), 1 << 63), i % 10) for i in range(4000)]
    df = spark.createDataFrame(data, "by string, at long, n long")
    got = sums.sorted_sums(df, ["by"], ["at"], {"upto": "n"})
    want, held = {}, {}
    for by, at, n in sorted(data, key=lambda r: (r[1],)):
        held[by] = held.get(by, 0) + n
        want[by, at] = held[by]
    assert {(r.by, r.at): r.upto for r in got.collect()} == want
    sizes = [r["count"] for r in sums.sorted_sums(df, [], ["at"], {"upto": "n"}).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert max(sizes) < 0.5 * len(data)


def test_positions_in_finer_buckets(spark, monkeypatch):
    assert [sums.bucket_digits(n) for n in (0, sums.BUCKET * 4096, sums.BUCKET * 4097, 10**15)] == [3, 3, 4, 6]
    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("key"), (F.col("id") % 2).alias("by"))
    want = {r.id: r.position for r in sums.global_position(df, "key", "id", by=["by"]).collect()}
    monkeypatch.setattr(sums, "bucket_digits", lambda n: 4)
    assert {r.id: r.position for r in sums.global_position(df, "key", "id", by=["by"]).collect()} == want
    assert sorted(r.position for r in sums.global_position(df, "key", "id").collect()) == [*range(3000)]
