"""Metrics, numbers, texts of calls, schedules, and raw files; literal cases are the fixed values of FIXTURES.md."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars, schedules
from millrace.operators import metrics
from millrace.sources import shards, sink


def series(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "r int, step long, value double")


def test_spike_rates_need_full_windows(spark):
    found = metrics.spikes(series(spark, [1, 2, 3, 4, 5, 100, 1]), ["r"], "step", ["value"], 5, 2.0)
    rows = metrics.spike_rates(found, ["r"], "step", 6, 5).orderBy("step").collect()
    assert [r.rolling_rate for r in rows] == [None] * 5 + [1 / 6, 1 / 6]
    assert [r.total_rate for r in rows] == [None] * 4 + [0.0, 1 / 6, 1 / 7]


def test_constant_series_has_no_spikes(spark):
    assert metrics.spikes(series(spark, [3] * 40), ["r"], "step", ["value"], 5, 2.0).where("spike").count() == 0


def test_windows_reach_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = rng.normal(size=500) + 9 * (rng.random(500) < 0.05)
    m = series(spark, values)
    whole = [r.spike for r in metrics.spikes(m, ["r"], "step", ["value"], 16, 2.0).orderBy("step").collect()]
    kept = [r.keep for r in metrics.kept_steps(m, ["r"], "step", ["value"], 16, 2.0).orderBy("step").collect()]
    want_spikes, want_kept = [], []
    for i, v in enumerate(values):
        past = values[max(0, i - 16) : i]
        want_spikes.append(len(past) == 16 and v > past.mean() + 2 * past.std())
        want_kept.append(not len(past) + 1 >= 8 or len(past) < 2 or bool(v - past.mean() <= 2 * past.std(ddof=1)))
    assert whole == want_spikes and kept == want_kept
    means = metrics.trailing_mean(m, "step", "value", 10, "mean").orderBy("step").collect()
    assert all(math.isclose(r["mean"], values[max(0, i - 9) : i + 1].mean(), rel_tol=1e-9, abs_tol=1e-12) for i, r in enumerate(means))


@pytest.mark.parametrize("width", [8, 40])
def test_blocks_of_other_widths(spark, width):
    from pyspark.sql import Window

    from millrace.operators.sums import in_blocks

    dealt, block = in_blocks(spark.range(100).withColumnRenamed("id", "k"), [], "k", 7, width)
    sums = dealt.withColumn("s", F.sum("k").over(Window.partitionBy(*block).orderBy("k").rowsBetween(-7, 0))).where("_own").orderBy("k").collect()
    assert [r.s for r in sums] == [sum(range(max(0, k - 7), k + 1)) for k in range(100)]


def test_merge_ignores_nulls(spark):
    m = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, 8.0), (2, 1, 5.0)], "k int, seq long, value double")
    rows = {r.k: r for r in metrics.merged(m, ["k"], "seq").collect()}
    assert rows[1]["mean"] == 5.5 and rows[1]["first"] == 2.0 and rows[2]["mean"] == 5.0


def test_as_of_keeps_an_entry_together(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 5, 7, 9000)], "k string, at long")
    plan = spark.createDataFrame([("a", 1, 10, "x"), ("a", 6, None, "y"), ("b", 0, 1, "z")], "k string, start long, size int, name string")
    got = metrics.as_of(rows, plan, ["k"], "at", "start", ["size", "name"], width=4).orderBy("at").collect()
    assert [(r["size"], r["name"]) for r in got] == [(None, None), (10, "x"), (None, "y"), (None, "y")]


def test_throughput_leaves_out_the_first_step(spark):
    t = spark.createDataFrame([(0, 1, 10.0, 100), (0, 2, 12.0, 100), (0, 3, 13.0, 100)], "r int, step long, s double, tokens long")
    rows = metrics.throughput(t, ["r"], "step", "s", "tokens").orderBy("step").collect()
    assert [r.tps for r in rows] == [None, 50.0, 100.0] and [r.tps_average for r in rows] == [None, 50.0, pytest.approx(200 / 3)]


def test_losses(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 0.5], 1), ([0.0, 0.0, 0.0], 2), ([5.0, 1.0, 1.0], -100)], "logits array<double>, label int")
    r = metrics.cross_entropy(rows, "logits", "label", z=0.5).first()
    lse = [math.log(sum(map(math.exp, x))) for x in ([1.0, 2.0, 0.5], [0.0, 0.0, 0.0])]
    assert r.rows == 2 and math.isclose(r.loss, (lse[0] - 2 + lse[1]) / 2) and math.isclose(r.z_loss, 0.5 * (lse[0] ** 2 + lse[1] ** 2) / 2)
    none = metrics.cross_entropy(rows.where("label < 0"), "logits", "label", z=0.5).first()
    assert math.isnan(none.loss) and math.isnan(none.z_loss)


def test_balanced_routers_have_the_least_loss(spark):
    even = spark.createDataFrame([([1.0 if j == i % 4 else 0.0 for j in range(4)],) for i in range(8)], "scores array<double>")
    skew = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],) for _ in range(8)], "scores array<double>")
    assert math.isclose(metrics.balancing_loss(even, 1).first().loss, 1.0) and math.isclose(metrics.balancing_loss(skew, 1).first().loss, 4.0)


@pytest.mark.parametrize("text, value", [("0.1 + 0.2", "0.3"), ("7 // 2", "3"), ("-7 // 2", "-4"), ("2 ** 10", "1024"), ("factorial(5)", "120"), ("sqrt(16)", "4"), ("-5 % 3", "1"), ("max(1, 2.5)", "2.5"), ("pi", "3.14159265359")])
def test_calculated(spark, text, value):
    r = spark.createDataFrame([(text,)], "t string").select(scalars.calculated("t").alias("r")).first().r
    assert (r.value, r.error) == (value, None)


@pytest.mark.parametrize("text", ["__import__('os')", "open('x')", "a + 1", "2 ** 5000", "factorial(5000)", "1 if 2 else 3", "True", "'a'", "1 / 0", "(", "abs(x=1)"])
def test_calculated_rejects(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(scalars.calculated("t").alias("r")).first().r
    assert r.value is None and r.error


@pytest.mark.parametrize("text, want", [
    ("none", []), (None, []), ("<function_calls>   </function_calls>", []),
    ('<function_calls>calculator(expression="5*5")', [("calculator", {"expression": '"5*5"'})]),
    ('x <function_calls>a(n=-1, l=[1, true])\nb()</function_calls> c(z=1)', [("a", {"n": "-1", "l": "[1, true]"}), ("b", {})]),
])
def test_function_calls(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(scalars.function_calls("t").alias("r")).first().r
    assert [(c.name, c.args) for c in r.calls] == want and r.error is None


@pytest.mark.parametrize("block", ["a(1)", "a(**b)", "x = 1", "a.b(c=1)", "a(b=c)", "a("])
def test_function_calls_reject(spark, block):
    r = spark.createDataFrame([(f"<function_calls>{block}</function_calls>",)], "t string").select(scalars.function_calls("t").alias("r")).first().r
    assert r.calls == [] and r.error


@pytest.mark.parametrize("x, want", [(1234.56, "1,234"), (2.5e9, "2.500B"), (1e-5, "1.00E-05"), (0.0, "0.0"), (151.05, "151.1"), (float("nan"), "nan"), (float("-inf"), "-inf"), (0.5, "0.5000"), (3.2e12, "3.200T")])
def test_short_floats(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(scalars.short_float(F.col("x"))).first()[0] == want


def test_short_texts(spark):
    df = spark.createDataFrame([(999, 999), (1500, 90_061), (2_000_000, 0)], "n long, s long")
    got = df.select(scalars.short_count(F.col("n")), scalars.short_int(F.col("n")), scalars.short_bytes(F.col("n")), scalars.short_seconds(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("999", "999", "999.0B", "16m, 39s"), ("1.5K", "1.5K", "1.5KiB", "1d, 1h, 1m, 1s"), ("2.0M", "2M", "1.9MiB", "0s")]


def test_short_texts_end_at_the_largest_unit(spark):
    df = spark.createDataFrame([(1_350_000_000_000, 3 << 30)], "n long, b long")
    got = df.select(scalars.short_count(F.col("n"), "B"), scalars.short_int(F.col("n"), "B"), scalars.short_bytes(F.col("b"), "Mi"), scalars.short_count(F.col("n")), scalars.short_bytes(F.col("b")))
    assert tuple(got.first()) == ("1350.0B", "1350B", "3072.0MiB", "1.4T", "3.0GiB")


def test_fingerprints_follow_rows_not_order(spark):
    rows = [(i, f"t{i}") for i in range(50)]
    a, b = (spark.createDataFrame(r, "k long, t string") for r in (rows, rows[::-1]))
    assert scalars.fingerprint(a).first() == scalars.fingerprint(b.repartition(5)).first() != scalars.fingerprint(a.union(a.limit(1))).first()


def test_names_and_folders(spark):
    df = spark.createDataFrame([("train/loss", 1, 3.0), ("train/loss", 2, 2.0), ("eval/loss", 1, 1.0), ("train/acc", 1, 9.0)], "name string, step long, value double")
    assert [(r.name, r.value) for r in metrics.latest(df, "train/l*").collect()] == [("train/loss", 2.0)]
    assert metrics.first_of(df.withColumn("p", F.col("step")), ["name"], "p").count() == 3


def test_window_starts_join(spark):
    steps = spark.createDataFrame([(100,), (105,), (200,), (400,)], "step long")
    assert sorted(tuple(r) for r in metrics.window_starts(steps, 300, 10).collect()) == [(91, 105), (191, 200)]


def test_schedules_start_and_end(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (100,)], "x long")
    x = F.col("x")
    get = lambda c: [r[0] for r in df.select(c.cast("double")).collect()]
    assert get(schedules.inverse_sqrt_with_warmup(x, 10.0, 0, 0.2))[0] == 2.0
    assert get(schedules.constant(x, 4.0)) == [4.0] * 4
    assert get(schedules.staged(x, 10.0, [{"duration": 10, "end": 5.0}])) == [10.0, 7.5, 5.0, 5.0]
    assert get(schedules.overridden(x, lambda s: schedules.staged(s, 10.0, [{"duration": 10, "end": 5.0}]), 5, 10, 2.5)) == [10.0, 7.5, 5.0, 2.5]
    assert get(schedules.periodic(x, 8.0, [10, 50], 2, 4))[:1] == [0.0] and get(schedules.periodic(x, 8.0, [10, 50], 2, 4))[-1] == 0.0
    assert get(schedules.sequential(x, 8.0, 100, [lambda x, r, t: schedules.linear_with_warmup(x, r, t, 0, 0.5), lambda x, r, t: schedules.constant(x, r)], [10])) == [8.0, 6.0, 4.0, 4.0]


@pytest.mark.parametrize("chunk", [3, 4, 5, 8, 1024])
def test_documents_of_files(spark, tmp_path, chunk):
    ids = [[*range(1, 9), 0, *range(1, 6), 0, 7], [0, 3, 0], []]
    for k, x in enumerate(ids):
        np.array(x, np.uint16).tofile(tmp_path / f"f{k}.npy")
        (np.array(x) != 3).tofile(tmp_path / f"m{k}.mask")
    files = [f for f in shards.listed(spark, str(tmp_path)) if f[0].endswith(".npy")]
    masks = [f for f in shards.listed(spark, str(tmp_path)) if f[0].endswith(".mask")]
    ranges = shards.token_ranges(spark, files, "u2", chunk)
    assert [x for r in ranges.where("path_idx = 0").orderBy("chunk_start").collect() for x in r.ids] == ids[0]
    for close, want in ((False, [(0, 0, 9), (0, 9, 15), (1, 0, 1), (1, 1, 3)]), (True, [(0, 0, 9), (0, 9, 15), (0, 15, 16), (1, 0, 1), (1, 1, 3)])):
        docs = shards.stream_documents(ranges, 0, close=close, mask=shards.token_ranges(spark, masks, "bool", chunk)).collect()
        assert sorted((r.path_idx, r.start, r.end) for r in docs) == want
        assert all(r.ids == ids[r.path_idx][r.start : r.end] and r.mask == [int(x != 3) for x in r.ids] for r in docs)
    assert shards.token_slice(spark, *files[0], "u2", 2, 5).first().ids == [3, 4, 5]


def test_files_are_written_whole_and_read_by_parts(spark, tmp_path):
    rows = [(k % 3, k, list(range(k * 10, k * 10 + k % 5))) for k in range(30)]
    df = spark.createDataFrame(rows, "source int, doc_id long, ids array<int>")
    written = sink.write_tokens(df, "source", "doc_id", str(tmp_path / "out"), "u4")
    files = shards.listed(spark, str(tmp_path / "out"))
    assert len(files) == 3 and {r.source: r.tokens for r in written.collect()} == {s: sum(len(x) for k, _, x in rows if k == s) for s in range(3)}
    got = shards.token_ranges(spark, files, "u4", 7)
    assert got.rdd.getNumPartitions() > 3
    for k in range(3):
        assert [x for r in got.where(f"path_idx = {k}").orderBy("chunk_start").collect() for x in r.ids] == [x for s, _, i in rows if s == k for x in i]
    counts = shards.token_counts(spark, [p for p, _ in files], "u4")
    named = spark.createDataFrame([("all", p) for p, _ in files], "source string, path string")
    assert shards.source_counts(counts, named).first().tokens == sum(len(x) for *_, x in rows)
    with pytest.raises(Exception, match="no such file"):
        shards.source_counts(counts, named.union(spark.createDataFrame([("all", "gone")], "source string, path string"))).collect()


def test_bounds_are_checked(spark):
    totals = spark.createDataFrame([(0, 10)], "path_idx int, tokens long")
    ok = spark.createDataFrame([(0, 0, 4), (0, 4, 10)], "path_idx int, start long, end long")
    assert shards.checked_bounds(ok, totals).count() == 2
    for bad in ((0, 4, 11), (0, 10, 10)):
        with pytest.raises(Exception, match="beyond the file"):
            shards.checked_bounds(spark.createDataFrame([bad], "path_idx int, start long, end long"), totals).collect()
    assert shards.sidecar_of("a/b.npy") == "a/b.csv.gz" and shards.sidecar_of("a/b.bin") is None


def test_seeds_permute_files():
    files = [(f"f{i}", i) for i in range(20)]
    assert shards.permuted(files, 1) == shards.permuted(files[::-1], 1) != shards.permuted(files, 2) and sorted(shards.permuted(files, 3)) == sorted(files)


def test_manifests_with_patterns(spark, tmp_path):
    from millrace.sources import tables

    for name in ("b", "a"):
        np.arange(4, dtype=np.uint16).tofile(tmp_path / f"{name}.npy")
    (tmp_path / "mix.txt").write_text("web,*.npy\n")
    manifest = tables.mix_manifest(spark, str(tmp_path / "mix.txt"), str(tmp_path), "tok")
    assert [(p.rsplit("/", 1)[1], n, label) for p, n, label in shards.labelled_files(manifest, spark)] == [("a.npy", 8, "web"), ("b.npy", 8, "web")]


def test_arithmetic_texts_follow_python():
    import math
    import random

    rng = random.Random(3)
    names = {n: getattr(math, n, None) or getattr(__import__("builtins"), n) for n in scalars.FUNCTIONS} | scalars.CONSTANTS | {"pow": pow, "__builtins__": {}}

    def text(depth=0):
        r = rng.random()
        if depth > 4 or r < 0.3:
            return rng.choice(["1", "2", "0.5", "1e2", ".25", "5.", "pi", "1_000", "0x1f"])
        if r < 0.6:
            return text(depth + 1) + rng.choice([" + ", "-", "*", "/", "//", "%"]) + text(depth + 1)
        if r < 0.66:
            return text(depth + 3) + " ** " + rng.choice(["2", "-1", "+3", "2**1"])
        if r < 0.75:
            return rng.choice("+-") + text(depth + 1)
        return rng.choice(["(%s)", "abs(%s)", "max(%s, 2)", "round(%s, 1)", "atan2(%s, 1,)", "( %s )"]) % text(depth + 1)

    for _ in range(1500):
        t = text()
        try:
            want = eval(t, names)
        except (ArithmeticError, TypeError, ValueError) as e:
            want = type(e)
        try:
            got = scalars.value_of(t)
        except (ArithmeticError, TypeError, ValueError) as e:
            got = type(e)
        assert isinstance(want, complex) or (type(got), got) == (type(want), want) or want != want, t
    for t in ("", "()", "1 2", "(1,2)", "max(1,,2)", "abs", "abs(1", "1)", "2(3)", "1+", "*1", "1;2", "[1]", "3 pi", "007", "sqrt(2)(3)", "-"):
        with pytest.raises(ValueError):
            scalars.value_of(t)
