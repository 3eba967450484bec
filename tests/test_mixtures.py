"""Mixtures, samples, slices and splits; literal cases are the fixed values of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import instances, mixing, ordering, sampling


def sources(spark, rows):
    return spark.createDataFrame([(n, k, r, float(rep), 1.0) for k, (n, r, rep) in enumerate(rows)], "source string, rank int, ratio double, repetition double, fraction double")


def files(spark, rows):
    return spark.createDataFrame([(s, f"{s}-{k}", k, n) for s, k, n in rows], "source string, path string, path_idx int, tokens long")


def test_mixture_meets_whole_batches(spark):
    found = files(spark, [("1", 0, 1_000_000), ("2", 0, 1_000_000), ("2", 1, 1_000_000), ("3", 0, 1_000_000), ("3", 1, 1_000_000)])
    plan = mixing.mixture_plan(sources(spark, [("1", 0.5, 3), ("2", 0.25, 1), ("3", 0.25, 1)]), found, F.lit(5_000_000), 32 * 1024, 1024)
    rows = plan.collect()
    assert sum(r.tokens for r in rows) == 5_013_504 and {r["pass"] for r in rows if r.source == "1"} == {0, 1, 2}
    assert all(r.tokens <= r.max_tokens and r.shortfall == 0 for r in rows)
    report = {r.source: r for r in mixing.mixture_report(plan, sources(spark, [("1", 0.5, 3), ("2", 0.25, 1), ("3", 0.25, 1)])).collect()}
    assert report["1"].passes == 3 and all(r.difference < 0.01 for r in report.values())


def test_too_small_a_source_is_an_error(spark):
    found = files(spark, [("1", 0, 1000), ("2", 0, 100_000)])
    with pytest.raises(Exception, match="too few tokens in source 1"):
        mixing.mixture_plan(sources(spark, [("1", 0.5, 1), ("2", 0.5, 1)]), found, F.lit(10_000), 128, 4).collect()


@pytest.mark.parametrize("tokens, repetition, requested, total", [((20_000, 20_000), 1, 10_000, 10_112), ((20_014, 20_001), 2, 40_000, 40_064)])
def test_mixture_instances(spark, tokens, repetition, requested, total):
    found = files(spark, [("a", 0, tokens[0]), ("b", 0, tokens[1])])
    plan = mixing.mixture_plan(sources(spark, [("a", 0.8, repetition), ("b", 0.2, 1)]), found, F.lit(requested), 128, 4)
    chunks = found.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("tokens div 4 - 1"))).alias("instance"))
    rows = mixing.mixture_instances(chunks, plan, ["path"]).orderBy("index").collect()
    assert len(rows) * 4 == total and [r["index"] for r in rows] == list(range(len(rows)))
    assert rows[0].instance == 0  # a path gives its beginning


def tokens_of(spark, ranges, streams):
    docs = spark.createDataFrame([(s, 0, len(ids), ids) for s, ids in streams.items()], "source string, start long, end long, ids array<int>")
    order = [c for c in ("index", "copy") if c in ranges.columns]
    rows = sampling.read_ranges(ranges, docs, ["source"]).orderBy(*order, "at").collect()
    return [x for r in rows for x in r.ids]


def ranges(spark, *rows):
    return spark.createDataFrame([(s, k, a, b) for k, (s, a, b) in enumerate(rows)], "source string, index int, start long, end long")


@pytest.mark.parametrize("most, want", [(16, [*range(8), *range(10, 18)]), (24, [*range(10), 0, 1, *range(10, 20), 10, 11])])
def test_sample_tokens(spark, most, want):
    found = sampling.sample_tokens(ranges(spark, ("a", 0, 10), ("b", 0, 10)), F.lit(most))
    assert tokens_of(spark, found, {"a": [*range(10)], "b": [*range(10, 20)]}) == want


@pytest.mark.parametrize("most, want", [(9, [*range(6), *range(3)]), (18, [*range(8), *range(4), *range(4), 0, 1])])
def test_samples_of_samples(spark, most, want):
    first = sampling.sample_tokens(ranges(spark, ("a", 0, 8)), F.lit(12)).select("source", F.col("copy").cast("int").alias("index"), "start", "end")
    assert tokens_of(spark, sampling.sample_tokens(first, F.lit(most)), {"a": [*range(8)]}) == want


def test_sample_with_a_seed_stays_inside(spark):
    found = sampling.sample_tokens(ranges(spark, ("a", 100, 200)), F.lit(130), seed=3).orderBy("copy").collect()
    assert [(r.start, r.end) for r in found][0] == (100, 200) and 100 <= found[1].start and found[1].end - found[1].start == 30 and found[1].end <= 200


def test_read_ranges_over_documents_and_cells(spark):
    ids = list(range(20_000))
    cuts = [0, 5, 4096, 9000, 9001, 20_000]
    docs = spark.createDataFrame([("a", a, b, ids[a:b]) for a, b in zip(cuts, cuts[1:])], "source string, start long, end long, ids array<int>")
    found = sampling.read_ranges(ranges(spark, ("a", 3, 9500), ("a", 8191, 8193), ("a", 19_999, 20_000), ("a", 7, 7)), docs, ["source"])
    rows = found.orderBy("index", "at").collect()
    got = {k: [x for r in rows if r["index"] == k for x in r.ids] for k in range(4)}
    assert got == {0: ids[3:9500], 1: ids[8191:8193], 2: ids[19_999:], 3: []}


@pytest.mark.parametrize("most, each", [(8, 4), (24, 12)])
def test_sample_instances(spark, most, each):
    rows = spark.range(16).select(F.when(F.col("id") < 8, "a").otherwise("b").alias("source"), (F.col("id") % 8).alias("position"))
    found = sampling.sample_instances(rows, ["source"], rows.groupBy("source").agg(F.count("*").alias("n")), F.lit(most))
    assert {r.source: r["count"] for r in found.groupBy("source").count().collect()} == {"a": each, "b": each}


@pytest.mark.parametrize("low, high, want", [(None, None, (0, 10)), (2, 5, (2, 5)), (-3, None, (7, 10)), (None, -3, (0, 7)), (4, 100, (4, 10)), (-100, 2, (0, 2))])
def test_slices(spark, low, high, want):
    r = sampling.sliced(ranges(spark, ("a", 0, 10)), F.col("end"), low, high).first()
    assert (r.start, r.end) == want


@pytest.mark.parametrize("low, high", [(5, 5), (8, 2), (10, None), (-2, -5)])
def test_empty_slices_are_errors(spark, low, high):
    with pytest.raises(Exception, match="empty slice"):
        sampling.sliced(ranges(spark, ("a", 0, 10)), F.col("end"), low, high).collect()


@pytest.mark.parametrize("size, n, want", [(16, 32, (24, 8)), (32, 16, (12, 4))])
def test_split_instances(spark, size, n, want):
    rows = sampling.split_instances(spark.range(n).withColumnRenamed("id", "position"), F.lit(n), 0.75, size, 32)
    assert tuple(rows.where(f"part = {k}").count() for k in (0, 1)) == want


def test_split_tokens_and_concatenation(spark):
    parts = sampling.split_tokens(ranges(spark, ("a", 0, 10), ("b", 4, 9)), 0.75)
    placed = sampling.concatenated(parts, ["part", "index"]).orderBy("offset").collect()
    assert [(r.source, r.part, r.start, r.end, r.offset) for r in placed] == [("a", 0, 0, 7, 0), ("b", 0, 4, 7, 7), ("a", 1, 7, 10, 10), ("b", 1, 7, 9, 13)]


def test_drawn_rows_come_from_the_table(spark):
    rows = sampling.drawn(spark.range(7).withColumnRenamed("id", "index"), F.count("*"), 200, 3, "index")
    assert rows.count() == 200 and {r["index"] for r in rows.collect()} == set(range(7))


def test_random_ids_do_not_follow_the_length(spark):
    one = [x for r in sampling.random_ids(spark.range(8).withColumnRenamed("id", "index"), 16, 100, 1, 0, 9).orderBy("index").collect() for x in r.input_ids]
    two = [x for r in sampling.random_ids(spark.range(4).withColumnRenamed("id", "index"), 32, 100, 1, 0, 9).orderBy("index").collect() for x in r.input_ids]
    assert one == two and 0 in one and max(one) < 100


def test_stable_chunks_hold_the_same_tokens(spark):
    docs = spark.createDataFrame([(0, 0, list(range(17)), 17), (1, 1, list(range(100, 115)), 15)], "source int, doc_id long, ids array<int>, n long")
    found = {s: instances.concat_and_chunk(docs, s, ["source"], "doc_id", most=8) for s in (8, 4)}
    assert {s: f.count() for s, f in found.items()} == {8: 3, 4: 6}
    tokens = [sorted(x for r in f.collect() for x in r.input_ids) for f in found.values()]
    assert tokens[0] == tokens[1]


def test_positions_within_sources(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("s"), F.expr("id div 3").alias("i"))
    placed = ordering.concatenated_sources(sampling.shuffled_within(rows, ["s"], "i", 1, 1), "s", "position").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(60)) and [r.s for r in placed] == [0] * 20 + [1] * 20 + [2] * 20
    turns = ordering.interleaved_sources(rows.where("NOT (s = 1 AND i > 10)"), "s", "i").orderBy("position").collect()
    assert len(turns) == 33 and [r.s for r in turns[:6]] == [0, 1, 2, 0, 1, 2]


def test_locate(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 0), ("c", 2)], "source string, size long")
    rows = sampling.locate(spark.range(5).withColumnRenamed("id", "index"), "index", sizes, ["source"]).orderBy("index").collect()
    assert [(r.source, r.local) for r in rows] == [("a", 0), ("a", 1), ("a", 2), ("c", 0), ("c", 1)]
