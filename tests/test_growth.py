"""What a plan costs as its input grows: no regular expression over whole texts, no task that makes all rows of a source."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import documents, instances, ordering
from millrace.plans import mixtures
from millrace.plans.base import ORACLES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["", " \t\n", "a", " a b \r\n", " 　ä  x ", "a\n", "\n\na\u0085\n", "​x​", "𝄞 \x1f", None])
def test_texts_lose_white_space_at_their_ends_without_a_search(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(documents.stripped(F.col("text")).alias("t"))
    assert df.first()[0] == (None if text is None else re.sub(f"^[{documents.SPACES}]+|[{documents.SPACES}]+$", "", text))
    assert "regexp_replace" not in plan_of(documents.lengths_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))


def test_tokens_are_made_in_slices(monkeypatch):
    monkeypatch.setattr(documents, "SLICE", 6)
    texts = ["ab", "", "c𝄞", "a long text", None, "x"]
    found = list(documents.code_points.func(iter([pa.array(texts), pa.array(["y"])])))
    assert len(found) > 3 and [x for part in found for x in part.to_pylist()] == [[*map(ord, t or ""), 0] for t in [*texts, "y"]]


def test_tokens_of_many_slices_stay_with_their_rows(spark):
    df = spark.range(3000).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("ä"), 1000)).alias("text")).coalesce(1)
    wrong = documents.tokenized(df).where((F.size("ids") != F.col("n")) | (F.array_join(F.transform(F.slice("ids", 1, F.char_length(F.col("id").cast("string"))), lambda x: F.char(x)), "") != F.col("id").cast("string")))
    assert wrong.count() == 0


def test_instances_of_one_source_are_numbered_by_many_tasks(spark):
    sizes = spark.createDataFrame([("a", 1003), ("b", 1), ("c", 0)], "source string, n long")
    rows = instances.numbered(sizes, ["source"], block=10).withColumn("task", F.spark_partition_id())
    assert sorted((r.source, r.instance) for r in rows.collect()) == [*(("a", i) for i in range(1003)), ("b", 0)]
    assert rows.where("source = 'a'").select("task").distinct().count() > 1


def test_numbers_of_a_shuffle_are_not_broadcast(spark):
    """Their plan starts from few blocks; only the table of buckets is sent to all, 4,096 rows at most."""
    sizes = spark.createDataFrame([("a", 200_003)], "source string, n long")
    placed = ordering.shuffled(instances.numbered(sizes, ["source"]), "instance", 4, 1, chunk=4)
    assert placed.select("position").distinct().count() == 200_003
    rows = placed.collect()
    assert all(r.position % 4 == r.instance % 4 for r in rows) and len({r.instance // 4: r.position // 4 for r in rows}) == 50_001
    assert "BroadcastHashJoin [_unit" not in plan_of(placed).split("Initial Plan")[0]


def test_sources_are_numbered_one_after_another_without_a_join(spark):
    sizes = spark.createDataFrame([("b", 3), ("a", 25), (None, 2), ("c", 0), ("d", 1)], "source string, n long")
    rows = instances.numbered(sizes, ["source"], block=10, index="index")
    want = [(s, i) for s, n in (("a", 25), ("b", 3), ("d", 1), (None, 2)) for i in range(n)]
    assert [(r["source"], r["instance"], r["index"]) for r in rows.orderBy("index").collect()] == [(*x, k) for k, x in enumerate(want)]
    assert "Join" not in plan_of(rows)


def test_instances_of_a_null_source_are_split_and_sliced_as_their_sql_does(spark, tmp_path):
    import duckdb

    texts = [(k, "x" * (37 * k % 900), None if k % 3 == 0 else f"s{k % 3}", "en", 0) for k in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("g4_slice_instances", "g6_split_instances", "g7_random_split"):
        found = getattr(mixtures, name)(spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({ORACLES[name]})").fetchall()
        key = lambda r: (r[0] or "", *r[1:])
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key) and any(r[0] is None for r in want), name


def test_lengths_of_pieces_need_no_tokens(spark):
    docs = documents.tokenized(spark.createDataFrame([(1, "x" * 9)], "doc_id long, text string"))
    cut = instances.pieces(docs, 4, "fragment")
    assert [(r.piece, r.n, len(r.ids)) for r in cut.orderBy("piece").collect()] == [(0, 4, 4), (1, 4, 4), (2, 2, 2)]
    assert "ArrowEvalPython" not in plan_of(cut.select("piece", "n"))


@pytest.mark.parametrize("known", [False, True])
def test_pieces_are_summed_on_their_lists(spark, known):
    rows = [(5, [3, 0, 4], 7), (1, [2], 2), (9000, [], 0), (9001, [1, 1], 2)]
    lens = spark.createDataFrame(rows, "k long, doc_lens array<int>, n long")
    found = documents.cumulative_lengths(lens if known else lens.drop("n"), "k")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 2, 2), (5, 0, 3, 5), (5, 2, 4, 9), (9001, 0, 1, 10), (9001, 1, 1, 11)]
    after = plan_of(found).split("ArrowEvalPython")[0]  # from the sums on lists to the result
    assert "Generate" in after and "Exchange" not in after and "Window" not in after
