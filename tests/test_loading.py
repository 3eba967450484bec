"""Loader plans, packing and collation; literal cases are the fixed values of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.operators import documents, instances, loading
from millrace.operators.loading import Cursor

P1 = [1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 0, 1, 2, 0]
P2 = [*range(1, 11), 0, 1, 2, 0]


def docs_of(spark, *files):
    rows = []
    for source, ids in enumerate(files):
        held = []
        for t in ids:
            held.append(t)
            if t == 0:
                rows.append((source, len(rows), held, len(held)))
                held = []
    return spark.createDataFrame(rows, "source int, doc_id long, ids array<int>, n long")


@pytest.mark.parametrize("strategy, last", [("truncate", [1, 2, 0, -1, -1, -1, -1, -1]), ("fragment", [9, 10, 0, 1, 2, 0, -1, -1])])
def test_packed_rows(spark, strategy, last):
    cut = instances.pieces(docs_of(spark, P1, P2), 8, strategy)
    bins = instances.packed(cut, 8, "source", "doc_id")
    rows = instances.packed_instances(cut, bins, 8, "source", "doc_id", -1).orderBy("source", "bin").collect()
    assert len(rows) == 6
    assert rows[1].input_ids == [1, 2, 3, 4, 5, 0, -1, -1] and rows[3].input_ids == [1, 2, 3, 0, 1, 2, 0, -1] and rows[3].doc_lens == [4, 3]
    assert rows[5].input_ids == last and rows[5].label_mask == [x >= 0 for x in last]


def test_packing_crosses_files_of_a_group(spark):
    cut = instances.pieces(docs_of(spark, [1, 2, 3, 4, 5, 0], [6, 0], [7, 8, 0]).withColumn("group", F.lit(0)), 8)
    rows = instances.packed_instances(cut, instances.packed(cut, 8, "group", "doc_id"), 8, "group", "doc_id", -1).orderBy("bin").collect()
    assert [r.input_ids for r in rows] == [[1, 2, 3, 4, 5, 0, 6, 0], [7, 8, 0, -1, -1, -1, -1, -1]]


@pytest.mark.parametrize("files, begin, want", [(([0, 1, 100, 0, *range(2, 11), 100], [0, *range(11, 21), 100, 0, 21, 22, 100]), 0, [3, 11, 12, 4])])
def test_pair_boundaries(spark, files, begin, want):
    rows = spark.createDataFrame([(k, ids) for k, ids in enumerate(files)], "path int, ids array<int>")
    places = rows.select("path", F.explode(documents.pair_places(F.col("ids"), F.lit(0), F.lit(None).cast("int"), 100, begin)).alias("end"))
    found = documents.boundaries(places, ["path"]).orderBy("path", "start").collect()
    assert [r.end - r.start for r in found] == want


def test_pairs_where_begin_is_end(spark):
    rows = spark.createDataFrame([(0, [0, 1, 0, 0, 2, 3, 0])], "path int, ids array<int>")
    places = documents.pair_places(F.col("ids"), F.lit(0), F.lit(None).cast("int"), 0, 0)
    assert rows.select(places.alias("p")).first().p == [3, 7]


@pytest.mark.parametrize("ids, want", [([100, 3, 4, 5, 5, 100, 6, 5, 100, 3, 5], [1, 5, 3, 2]), ([3, 4, 5, 5, 100, 6, 5, 100, 3, 5, 100], [5, 3, 3]), ([], []), ([7], [1])])
def test_lengths(spark, ids, want):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(documents.lengths(F.col("ids"), 100)).first()[0] == want


def test_cumulative_lengths(spark):
    rows = spark.createDataFrame([(0, [1, 5, 3, 2, 0]), (1, [5, 3, 3, 0, 0])], "row long, doc_lens array<int>")
    assert [r.end for r in documents.cumulative_lengths(rows, "row").orderBy("end").collect()] == [1, 6, 9, 11, 16, 19, 22]


def test_token_batches(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([4, 4, 2, 2, 2, 2, 2])], "k long, n long")
    assert [r.batch for r in loading.token_batches(rows, "k", "n", 8).orderBy("k").collect()] == [0, 0, 1, 1, 1, 1, 2]


@pytest.mark.parametrize("lengths, message", [([4, 2], "differ"), ([9], "exceeds")])
def test_token_batches_reject(spark, lengths, message):
    rows = spark.createDataFrame(list(enumerate(lengths)), "k long, n long")
    with pytest.raises(Exception, match=message):
        loading.token_batches(rows, "k", "n", 8).collect()


def test_collated(spark):
    rows = spark.createDataFrame([(0, [1, 5, 3, 2]), (0, [5, 3, 3]), (1, [])], "batch int, lens array<int>")
    got = loading.collated(rows, "batch", {"lens": 0}).orderBy("batch", F.size("lens"), "lens").collect()
    assert [r.lens for r in got] == [[1, 5, 3, 2], [5, 3, 3, 0], []]
    assert sorted(r.lens for r in loading.collated(rows, "batch", {"lens": 0}, "left").collect()) == [[], [0, 5, 3, 3], [1, 5, 3, 2]]


def buckets(spark):
    return spark.createDataFrame([(i, n) for n, c in ((2, 40), (4, 21), (8, 9)) for i in range(n * 1000, n * 1000 + c)], "index long, length long")


def test_bucket_batches_are_full_and_ranks_contiguous(spark):
    rows = buckets(spark)
    plan = loading.bucket_plan(rows, 16)
    assert [(r.length, r.per, r.batches, r["first"]) for r in plan.orderBy("length").collect()] == [(2, 8, 5, 0), (4, 4, 5, 5), (8, 2, 4, 10)]
    found = loading.bucket_batches(rows, plan, "index", 2, 1, 1).collect()
    assert len({r["index"] for r in found}) == len(found) == 40 + 20 + 8
    for b in range(14):
        some = sorted((r.slot, r["rank"], r.length) for r in found if r.batch == b)
        assert sum(n for *_, n in some) == 16 and [rank for _, rank, _ in some] == sorted(rank for _, rank, _ in some)


def test_natural_order_begins_with_the_longest(spark):
    order = loading.natural_order(loading.bucket_plan(buckets(spark), 16), 3, 1).orderBy("position").collect()
    assert [r.position for r in order] == list(range(14)) and order[0].bucket == 2 and sorted(r.batch for r in order) == list(range(14))


@pytest.mark.parametrize("kind", ["power", "linear"])
def test_growth_uses_every_batch_once(spark, kind):
    rows = spark.createDataFrame([(i, n) for n, c in ((2, 400), (4, 240), (8, 130)) for i in range(n * 1000, n * 1000 + c)], "index long, length long")
    plan = loading.bucket_plan(rows, 16, cycles=2)
    growth = loading.growth_plan(plan, kind, 2)
    order = loading.growth_order(growth, 1, 1).orderBy("position").collect()
    total = sum(r.batches for r in plan.collect())
    assert [r.position for r in order] == list(range(total)) and sorted(r.batch for r in order) == list(range(total))
    share = {(r.step, r.bucket): r.batches for r in growth.where("cycle = 0").collect()}
    assert share[(0, 0)] > share[(2, 0)] and share[(0, 2)] < share[(2, 2)]  # short ones first, long ones later
    even = loading.bucket_plan(rows, 16, cycles=2, balanced=True).collect()
    assert len({r.batches for r in even}) == 1


def test_growth_with_shares_rounded_up_takes_from_the_last_steps(spark):
    plan = spark.createDataFrame([(k, 33 * k, 33) for k in range(6)], "bucket long, first long, batches long")
    growth = loading.growth_plan(plan, "linear", 3)
    assert [r.batches for r in growth.where("bucket = 0 AND cycle = 0").orderBy("step").collect()] == [3, 3, 2, 2, 1, 0]
    assert sorted(r.batch for r in loading.growth_order(growth, 1, 1).collect()) == list(range(198))
    many = spark.createDataFrame([(k, 34 * k, 34) for k in range(8)], "bucket long, first long, batches long")
    counts = loading.growth_plan(many, "linear", 1).groupBy("bucket").agg({"batches": "sum"}).collect()
    least = loading.growth_plan(many, "linear", 1).agg({"batches": "min"}).first()[0]
    assert {r[1] for r in counts} == {34} and least >= 0


def test_cursor():
    c = Cursor(("a", "b"), 16).advanced(4)
    state = c.state()
    assert (c.batches, c.tokens) == (4, 64) and Cursor(("a", "b"), 32).restored(state).batches == 2
    assert Cursor(("a", "b", "c"), 16).restored(state).batches == 4
    with pytest.raises(ValueError, match="other sources"):
        Cursor(("b", "a"), 16).restored(state)
    assert Cursor(("b", "a"), 16).restored(state, ignore_fingerprints=True).tokens == 64
    with pytest.raises(ValueError, match="appended"):
        Cursor(("a", "b", "c"), 16).restored(state | {"epoch": 3})
    with pytest.raises(ValueError, match="another order"):
        Cursor(("a", "b"), 16, order="natural").restored(state)
    assert c.rescaled(32).batches == 2 and c.rescaled(8).batches == 8 and c.rescaled(32).tokens == 64
    for wrong in (24, 16 * 3):
        with pytest.raises(ValueError):
            c.rescaled(wrong)


def test_array_transforms(spark):
    df = spark.createDataFrame([(list(range(12)), [True, True, False, True]), ([], [])], "x array<int>, m array<boolean>")
    got = df.select(arrays.melted(F.col("x"), 4).alias("melt"), arrays.chunked(F.col("x"), [5, 7]).alias("chunks"), arrays.truncated(F.col("x"), 3).alias("cut"), arrays.runs(F.col("m")).alias("runs"), arrays.top_k(F.col("x").cast("array<double>"), 2).alias("k"), arrays.top_p(F.col("x").cast("array<double>"), 0.5).alias("p")).collect()
    assert got[0].melt == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]] and got[0].chunks == [list(range(5)), list(range(5, 12))] and got[0].cut == [0, 1, 2]
    assert [(r.value, r.start, r.end) for r in got[0].runs] == [(True, 0, 2), (False, 2, 3), (True, 3, 4)]
    assert got[1].melt == [] and got[1].runs == [] and got[1].k == [] and got[1].p == []


@pytest.mark.parametrize("mask, want", [([False, False, True, True], (2, True)), ([False, True, False], (1, False)), ([True], (0, True)), ([False], (None, False)), ([], (None, False))])
def test_left_padding(spark, mask, want):
    df = spark.createDataFrame([(mask,)], "m array<boolean>")
    assert tuple(df.select(*arrays.left_padding(F.col("m"))).first()) == want


def test_masks_that_do_not_fit_are_errors(spark):
    rows = spark.createDataFrame([(1, [1, 2])], "k int, ids array<int>")
    with pytest.raises(Exception, match="doesn't fit 1"):
        instances.masked(rows, spark.createDataFrame([(1, [True])], "k int, mask array<boolean>"), "k").collect()


def test_experts_gather_and_scatter(spark):
    picks = spark.createDataFrame([(r, e, 0.5, float(r)) for r in range(6) for e in (0, 1 + r % 2)], "row long, expert int, weight double, value double")
    placed = loading.gathered(picks, "expert", "row", 4)
    assert sorted((r.row, r.place, r.kept) for r in placed.where("expert = 0").collect()) == [(r, r, r < 4) for r in range(6)]
    mixed = {r.row: r.x for r in loading.scattered(placed, "row", "x").collect()}
    assert mixed == {r: float(r) for r in range(6)}
