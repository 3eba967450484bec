import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, schedules
from millrace.operators import documents, instances, metrics, mixing, ordering, repetition
from millrace.operators.sums import running_sum
from millrace.sources import tables


def docs_of(spark, *streams, end=0):
    """A source for each stream, its documents cut after each end token."""
    rows = []
    for source, stream in enumerate(streams):
        held = []
        for t in stream:
            held.append(t)
            if t == end:
                rows.append((source, len(rows), held, len(held)))
                held = []
        if held:
            rows.append((source, len(rows), held, len(held)))
    return spark.createDataFrame(rows, "source int, doc_id long, ids array<long>, n long")


# Arrays and results of the cases in FIXTURES.md, here and below.
P1 = [1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 0, 1, 2, 0]


def test_concat_and_chunk(spark):
    docs = docs_of(spark, list(range(16)), list(range(16, 32)), end=-1)
    rows = instances.concat_and_chunk(docs, 4, ["source"], "doc_id").orderBy("source", "instance").collect()
    assert [r.input_ids for r in rows] == [list(range(i, i + 4)) for i in range(0, 32, 4)]


def test_document_lengths(spark):
    docs = docs_of(spark, [1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0], [*range(11, 21), 0, 21, 22, 0])
    rows = instances.concat_and_chunk(docs, 4, ["source"], "doc_id").withColumn("lens", documents.lengths(F.col("input_ids")))
    assert [r.lens for r in rows.orderBy("source", "instance").collect()] == [[2, 2], [4], [4], [4], [4], [3, 1]]


def test_boundaries(spark):
    tokens = spark.createDataFrame([(0, [*range(1, 9), 0, *range(1, 6), 0, 7])], "path int, ids array<int>")
    places = tokens.select("path", F.explode(documents.end_places(F.col("ids"), F.lit(0))).alias("end"))
    rows = documents.boundaries(places, ["path"]).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 9), (9, 15)]
    totals = tokens.select("path", F.size("ids").cast("long").alias("tokens"))
    rows = documents.boundaries(places, ["path"], totals).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 9), (9, 15), (15, 16)]


def test_tokenized_strips_and_skips(spark):
    texts = spark.createDataFrame([(0, "en", " a "), (1, "en", "   "), (2, "en", "bc"), (3, "en", None), (4, "en", "　\x1f")], "doc_id long, lang string, text string")
    assert [r.ids for r in documents.tokenized(texts).orderBy("doc_id").collect()] == [[97, 0], [98, 99, 0]]
    r = documents.export_statistics(texts, "lang").first()
    assert (r.documents, r.tokens, r.longest, r.longest_with_end, r.skipped) == (2, 5, 2, 3, 3)


def test_padded_truncates(spark):
    docs = docs_of(spark, [1, 2, 3, 4, 5, 6, 7, 0, 8, 9, 10, 0], [*range(11, 21), 0, 21, 22, 0])
    rows = instances.padded(docs, 8, 0).orderBy("doc_id").collect()
    assert rows[1].input_ids == [8, 9, 10, 0, 0, 0, 0, 0] and rows[1].label_mask == [True] * 4 + [False] * 4
    assert rows[2].input_ids == list(range(11, 19))


@pytest.mark.parametrize("lengths, size, bins", [([8, 6, 6, 4, 3, 2, 3], 8, [0, 1, 2, 3, 3, 1, 4]), ([8, 6, 6, 4, 3], 8, [0, 1, 2, 3, 3])])
def test_best_fit_order(lengths, size, bins):
    assert instances.best_fit(lengths, size) == bins


def test_packed(spark):
    bins = instances.packed(instances.pieces(docs_of(spark, P1), 8), 8, "source", "doc_id")
    filled = {r.bin: r.filled for r in bins.groupBy("bin").agg(F.sum("n").alias("filled")).collect()}
    assert len(filled) == 4 and sum(filled.values()) == 27 and max(filled.values()) <= 8


def test_power_pieces(spark):
    docs = documents.offsets(docs_of(spark, [*range(1, 13), 0, *range(1, 6), 0, 1, 2, 0]), ["source"], "doc_id")
    rows = instances.power_pieces(docs, 1, 2).orderBy("piece_start").collect()
    assert [(r.piece_start, r.piece_start + r.length) for r in rows] == [(0, 4), (4, 8), (8, 12), (13, 17), (17, 19), (19, 21)]


@pytest.mark.parametrize("sizes, ratios, repeats, target, want", [([8, 16], [0.5, 0.5], [1, 1], None, [8, 8]), ([8, 8, 16], [0.3, 0.2, 0.5], [1, 1, 1], None, [8, 5, 13]), ([8, 16], [0.5, 0.5], [2, 1], None, [12, 12]), ([8, 16], [0.5, 0.5], [1, 1], 16, [8, 8])])
def test_sample_sizes(spark, sizes, ratios, repeats, target, want):
    plan = spark.createDataFrame([(i, s, r, float(k)) for i, (s, r, k) in enumerate(zip(sizes, ratios, repeats))], "i int, size long, ratio double, repetition double")
    assert [r["sample"] for r in mixing.sample_sizes(plan, target).orderBy("i").collect()] == want


def test_apportion_sums_and_caps(spark):
    plan = spark.createDataFrame([(0, 700, 2000), (1, 330, 330), (2, 650, 900)], "i int, tokens long, max_tokens long")
    rows = mixing.apportion(plan, 20, 64, "i").orderBy("i").collect()
    assert [r.instances for r in rows] == [10, 5, 10]
    rows = mixing.apportion(plan, 26, 64, "i").orderBy("i").collect()
    assert sum(r.instances for r in rows) == 26 and all(r.instances <= r.max_tokens // 64 for r in rows)


def test_sample_documents(spark):
    docs = spark.createDataFrame([(0, 5), (1, 4), (2, 3), (3, 2)], "position long, n long")
    assert mixing.sample_documents(docs, F.lit(13), "position").count() == 3
    rows = mixing.sample_documents(docs, F.lit(20), "position")
    assert rows.count() == 5 and rows.agg(F.sum("n")).first()[0] == 19


def test_running_sum_over_blocks(spark):
    values = [(i % 3, i, i * 7 % 11) for i in range(5000)]
    rows = running_sum(spark.createDataFrame(values, "g long, i long, v long"), ["g"], "i", "v", "s", block=64).collect()
    want, sums = {}, [0, 0, 0]
    for g, i, v in values:
        sums[g] += v
        want[i] = sums[g]
    assert {r.i: r.s for r in rows} == want


def test_shuffle_is_a_permutation_of_chunks(spark):
    rows = ordering.shuffled(spark.range(100).withColumnRenamed("id", "i"), "i", 3, 1, chunk=4).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(100))
    order = [r.i for r in rows]
    assert order != list(range(100)) and all(order[k + j] == order[k] + j for k in range(0, 100, 4) for j in range(4))


def test_batches_cover_each_row_once(spark):
    rows = ordering.batches(spark.range(50).withColumnRenamed("id", "position"), 8, 4)
    assert rows.count() == 48 and rows.where("rank = 1 AND batch = 0").orderBy("slot").select("slot").toPandas().slot.tolist() == [1, 5]
    assert ordering.restored(rows, 64, 32).agg(F.min("batch")).first()[0] == 2


def brute_runs(a, p):
    out, i = [], 0
    while i + p < len(a):
        j = i
        while j + p < len(a) and a[j] == a[j + p]:
            j += 1
        if j > i and (j - i + p) // p >= 3:
            out.append((i, j + p, p, (j - i + p) // p))
        i = max(j, i + 1)
    return out


def test_repetition():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 3, rng.integers(0, 40))
        want = [r for p in range(1, min(13, len(a) // 3) + 1) for r in brute_runs(a.tolist(), p)]
        assert repetition.periodic_runs(a) == want


def test_label_losses(spark):
    losses = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("b", 5.0, True), ("b", 6.0, True), ("b", 9.0, False)], "label string, loss double, keep boolean")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    rows = {r.label: r.ce_loss for r in metrics.label_losses(losses, labels).collect()}
    assert rows["a"] == 1.5 and rows["b"] == 5.5 and np.isnan(rows["c"])


def test_merge_runs_pairwise(spark):
    m = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 8.0)], "step int, seq int, value double")
    r = metrics.merged(m, ["step"], "seq").first()
    assert (r["first"], r["last"], r["sum"], r["max"], r["min"], r["mean"]) == (2.0, 8.0, 14.0, 8.0, 2.0, 5.5)


def test_spikes(spark):
    m = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 100])], "r int, step int, value double")
    assert [r.spike for r in metrics.spikes(m, ["r"], "step", ["value"], 5, 2.0).orderBy("step").collect()] == [False] * 5 + [True]


def test_arrays(spark):
    df = spark.createDataFrame([([0.4, 0.3, 0.2, 0.1],)], "x array<double>")
    low = float("-inf")
    assert df.select(arrays.top_k(F.col("x"), 2)).first()[0] == [0.4, 0.3, low, low]
    logs = df.select(F.transform("x", lambda v: F.log(v)).alias("x"))
    assert [v > low for v in logs.select(arrays.top_p(F.col("x"), 0.5)).first()[0]] == [True, True, False, False]
    assert df.select(arrays.argmax(F.col("x"))).first()[0] == 0 and df.select(arrays.top_experts(F.col("x"), 2)).first()[0] == [0, 1]


def test_schedules(spark):
    x = F.col("id")
    df = spark.createDataFrame([(0,), (1000,), (3000,), (10000,)], "id long")
    for s in (schedules.linear_with_warmup, schedules.cosine_with_warmup):
        assert [round(r[0], 9) for r in df.select(s(x, 10.0, 10_000, 3000, 0.2, 4.0)).collect()] == [4, 6, 10, 2]


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("0,9,x\n9,15,y\n")
    read = tables.sidecar(spark, str(tmp_path / "a.csv.gz"))
    assert [(r.start, r.end) for r in read.orderBy("start").collect()] == [(0, 9), (9, 15)]
    (tmp_path / "mix.txt").write_text("# c\nweb,data/{TOKENIZER}/x.bin\n\n")
    assert tables.mix_manifest(spark, str(tmp_path / "mix.txt"), "s3://b/", "tok").first().path == "s3://b/data/tok/x.bin"
    assert tables.mix_manifest(spark, str(tmp_path / "mix.txt"), "s3://b/", "tok", {"web": "common"}).first().label == "common"
    assert [tables.token_width(v) for v in (256, 257, 65536, 65537)] == ["u1", "u2", "u2", "u4"]
