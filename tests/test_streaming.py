import numpy as np
import pytest

from millrace.operators import metrics
from millrace.streaming import spikes


def test_stream_finds_what_the_window_finds(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, float(rng.normal() + 8 * (rng.random() < 0.05))) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    for k in range(3):  # three files, three batches, state carried over
        df.where(f"event_id div 200 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spikes.spikes(spikes.replay(spark, str(tmp_path / "events")), "user_id", "event_id", "value", 8, 2.0)
    got = {r.event_id: r.spike for r in spikes.drained(stream).collect()}
    want = {r.event_id: r.spike for r in metrics.spikes(df, ["user_id"], "event_id", ["value"], 8, 2.0).collect()}
    assert got == want and any(got.values())


def brute(rows, window, sigmas):
    past, out = {}, {}
    for i, user, x in rows:
        seen = past.setdefault(user, [])
        before = np.array(seen[-window:])
        out[i] = bool(len(before) == window and before.std() >= 1e-10 and x > before.mean() + sigmas * before.std())
        seen.append(x)
    return out


def events(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, 0 if i % 4 else int(rng.integers(1, 4)), float(rng.normal() + 8 * (rng.random() < 0.05))) for i in range(n)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = events(900, 1)
    schema = "event_id long, user_id long, value double"
    folder, source = str(tmp_path / "state"), str(tmp_path / "events")
    late = [(5000, 1, 50.0), (5001, 0, 60.0)]  # of steps that are past when they come
    for k, part in enumerate((rows[:300], rows[300:600], [*rows[600:], *late])):
        spark.createDataFrame(part[::-1], schema).repartition(1).write.mode("append").parquet(source)
        stream = spikes.spikes(spikes.replay(spark, source), "user_id", "event_id", "value", 8, 2.0)
        got = {r.event_id: r.spike for r in spikes.drained(stream, folder).collect()}
        want = brute([*rows, *late][: 300 * (k + 1) + (2 if k == 2 else 0)], 8, 2.0)
        assert got == want and any(got.values())
    states = sorted(p.name for p in (tmp_path / "state" / "state").iterdir() if p.is_dir())
    assert states == ["1", "2"]
    sizes = spark.read.parquet(f"{folder}/state/2").groupBy("user_id").count().collect()
    assert all(r["count"] <= 8 for r in sizes)


def test_late_rows_are_the_next_of_their_series(spark):
    schema = "event_id long, user_id long, value double"
    rows = events(200, 2)
    plan = spikes.Spikes(spark.createDataFrame(rows, schema), "user_id", "event_id", "value", 5, 1.5)
    _, state = plan.fold(spark.createDataFrame(rows[50:], schema), None)
    found, _ = plan.fold(spark.createDataFrame(rows[:50], schema), state)
    want = brute([*rows[50:], *rows[:50]], 5, 1.5)
    assert {r.event_id: r.spike for r in found.collect()} == {i: want[i] for i in range(50)}


def test_a_long_series_in_one_batch_is_spread(spark):
    schema = "event_id long, user_id long, value double"
    rows = [(i, 7, x) for i, _, x in events(20_000, 3)]
    found, state = spikes.Spikes(spark.createDataFrame(rows, schema), "user_id", "event_id", "value", 16, 2.5).fold(spark.createDataFrame(rows, schema), None)
    assert {r.event_id: r.spike for r in found.collect()} == brute(rows, 16, 2.5) and state.count() == 16
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_loader_goes_on_after_a_stop(spark, tmp_path):
    from millrace.operators.loading import Cursor
    from millrace.operators.ordering import shuffled
    from millrace.streaming import loader

    plan = shuffled(spark.range(103).withColumnRenamed("id", "instance"), "instance", 3, 1)
    order = [r.instance for r in plan.orderBy("position").collect()]
    folder = str(tmp_path / "loader")
    cursor = Cursor(("a",), batch_tokens=80, seed=3)

    def read():
        rows = spark.read.parquet(f"{folder}/rows").orderBy("batch", "slot").collect()
        return [(r.batch, r.slot, r.instance) for r in rows]

    stopped = loader.run(plan, cursor, 10, folder, batches=2, stop=5)
    assert (stopped.batches, stopped.tokens) == (5, 400) and read() == [(k // 10, k % 10, order[k]) for k in range(50)]
    ended = loader.run(plan, cursor, 10, folder, batches=2)  # what is left of the epoch then is no whole batch
    assert ended.batches == 10 and read() == [(k // 10, k % 10, order[k]) for k in range(100)]
    assert loader.run(plan, cursor, 10, folder, batches=2) == ended
    assert loader.run(plan, Cursor(("a", "b"), batch_tokens=80, seed=3), 10, folder, batches=2).batches == 10
    for other in (Cursor(("b",), batch_tokens=80, seed=3), Cursor(("a",), batch_tokens=40, seed=3), Cursor(("a",), batch_tokens=80, seed=4)):
        with pytest.raises(ValueError):
            loader.run(plan, other, 10, folder, batches=2)
