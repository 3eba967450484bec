"""Batch sizes that change, durations, metric files and manifests."""

import math
import random
from fnmatch import fnmatch

import numpy as np
import pytest

from millrace.operators import loading, metrics
from millrace.sources import shards, tables


def walked(schedule, total, unit="tokens"):
    """Batches (step, first token, size) as a loop over steps takes them."""
    step, token, size, out = 0, 0, schedule[0][1], []
    while True:
        for start, want in reversed(schedule):
            if (token if unit == "tokens" else step) >= start:
                if want < size or want > size and token // size % (want // size) == 0:
                    size = want
                break
        if token + size > total:
            return out
        out.append((step, token, size))
        step, token = step + 1, token + size


@pytest.mark.parametrize("schedule", [[(0, 8)], [(0, 8), (20, 32), (200, 16)], [(0, 32), (100, 8), (120, 16), (300, 64)], [(0, 8), (1, 16), (2, 32)], [(0, 64), (10, 16), (11, 8)], [(0, 8), (9, 64), (30, 128)]])
@pytest.mark.parametrize("unit", ["tokens", "steps"])
def test_batches_of_changing_sizes(spark, schedule, unit):
    scaled = schedule if unit == "tokens" else [(-(-s // 8), n) for s, n in schedule]
    if len({s for s, _ in scaled}) < len(scaled):
        scaled = [(k, n) for k, (_, n) in enumerate(scaled)]
    rows = 250
    plan = loading.segments(scaled, unit)
    found = loading.scheduled_batches(spark.range(rows).withColumnRenamed("id", "position"), plan, 4).collect()
    want = walked(scaled, rows * 4, unit)
    got = {}
    for r in found:
        got.setdefault((r.batch, r.tokens, r.batch_tokens), []).append((r.slot, r.position))
        assert math.isclose(r.factor, math.sqrt(r.batch_tokens / scaled[0][1]))
    assert sorted(got) == want
    assert all(sorted(x) == [(s, t // 4 + s) for s in range(n // 4)] for (_, t, n), x in got.items())


@pytest.mark.parametrize("schedule", [[], [(1, 8)], [(0, 8), (5, 12)], [(0, 8), (5, 8)], [(0, 8), (5, 16), (5, 32)]])
def test_schedules_that_are_errors(schedule):
    with pytest.raises(ValueError):
        loading.segments(schedule)


def test_durations(spark):
    plan = spark.range(20).withColumnRenamed("id", "batch")
    assert loading.until(plan, steps=3).count() == 3 and loading.until(plan, tokens=100, batch_tokens=32).count() == 4 and loading.until(plan, tokens=64, batch_tokens=32).count() == 2


def test_metric_files_of_several_folders(spark, tmp_path):
    rng = random.Random(1)
    names = ["loss/a", "loss/b", "speed"]
    rows = sorted({(rng.choice(names), rng.randint(0, 60)) for _ in range(70)})
    data = [(n, s, float(s) + len(n)) for n, s in rows]
    df = spark.createDataFrame(data, "name string, step long, value double")
    shots = metrics.step_metrics(df, every=10, fixed=[7], pattern="loss/*")
    last = max(s for _, s in rows)
    steps = {s for _, s in rows if s % 10 == 0 or s == 7 or s == last}
    held = {s: {n: v for n, t, v in sorted(data, key=lambda r: r[1]) if t <= s and fnmatch(n, "loss/*")} for s in steps}
    assert {r.step: r.metrics for r in shots.collect()} == {s: m for s, m in held.items() if m}
    metrics.write_metrics(shots.where("step % 20 = 0"), str(tmp_path / "one"))
    metrics.write_metrics(spark.createDataFrame([(s, {"loss/a": -1.0, "other": 2.0}) for s in held], "step long, metrics map<string,double>"), str(tmp_path / "two"))
    read = metrics.read_metrics(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    got = {}
    for r in read.collect():
        got.setdefault((r.step, r.folder), {})[r.name] = r.value
    first = {s for s, m in held.items() if s % 20 == 0 and m}
    assert got == {(s, 0) if s in first else (s, 1): held[s] if s in first else {"loss/a": -1.0, "other": 2.0} for s in held}
    table = metrics.checkpoint_table(read, "run", 100, ["loss/a", "none"], {"size": 5}).collect()
    assert sorted((r.step, r.tokens, r.size, r.none) for r in table) == [(s, 100 * s, 5, None) for s in sorted(held)]
    assert {r.name for r in metrics.read_metrics(spark, [str(tmp_path / "two")], prefix="oth").collect()} == {"other"}


def manifest(spark, tmp_path, text, **settings):
    (tmp_path / "mix.txt").write_text(text)
    return tables.mix_manifest(spark, str(tmp_path / "mix.txt"), "/base/", "tok", **settings)


def test_manifests_keep_their_order_and_name_bad_lines(spark, tmp_path):
    good = "# c\n\nweb,a/{TOKENIZER}/x\r\nweb, b/{TOKENIZER}/{TOKENIZER}\nbooks,c/{TOKENIZER}\n"
    assert [(r.place, r.label, r.path) for r in manifest(spark, tmp_path, good, strict=True, aliases={"books": "b"}).orderBy("place").collect()] == [(3, "web", "/base/a/tok/x"), (4, "web", "/base/b/tok/tok"), (5, "b", "/base/c/tok")]
    for text, message in (("web,a/{TOKENIZER}\nweb\n", "line 2 .* no label and path"), ("web,a,b/{TOKENIZER}", "line 1"), ("#\nweb,a/{TOKENIZER}\nb,c/{TOKENIZER}\nweb,d/{TOKENIZER}", "line 4 .* came before"), ("web,a/{TOKENIZER}\nweb,plain", "line 2 .* names no")):
        with pytest.raises(Exception, match=message):
            manifest(spark, tmp_path, text, strict=True).collect()


def test_files_of_a_manifest_come_from_one_listing(spark, tmp_path):
    for name in ("b/2", "b/1", "a/9", "c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        np.arange(5, dtype=np.uint16).tofile(tmp_path / f"{name}.npy")
    (tmp_path / "mix.txt").write_text("x,b/*.npy\ny,c.npy\nz,a/?.npy\n")
    found = tables.mix_manifest(spark, str(tmp_path / "mix.txt"), str(tmp_path), "tok")
    assert [(p.rsplit("/", 1)[1], n, label) for p, n, label in shards.labelled_files(found, spark)] == [("1.npy", 10, "x"), ("2.npy", 10, "x"), ("c.npy", 10, "y"), ("9.npy", 10, "z")]
