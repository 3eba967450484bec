"""Metrics of training and evaluation: masked means, reductions over ranks, merges, spikes, throughput, schedules."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import let, log_sum_exp, top_experts
from millrace.functions.scalars import name_matches
from millrace.operators.intervals import within
from millrace.operators.sums import in_blocks, ranked, running_sum

NAN = float("nan")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(NAN))


def label_losses(losses: DataFrame, labels: DataFrame, label: str = "label", loss: str = "loss", keep: str = "keep") -> DataFrame:
    """Per label of ``labels``: mean loss over kept positions and its perplexity; NaN for labels without any."""
    mean = losses.groupBy(label).agg(weighted_mean(F.col(loss), F.col(keep).cast("double")).alias("ce_loss"))
    joined = labels.select(label).distinct().join(mean, label, "left")
    ce = F.coalesce("ce_loss", F.lit(NAN))
    return joined.select(label, ce.alias("ce_loss"), F.exp(ce).alias("ppl"))


def reduced(metrics: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Reductions over ranks: mean over those that reported, sum, max and L2 norm."""
    v = F.col(value)
    return metrics.groupBy(*by).agg(F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.sqrt(F.sum(v * v)).alias("l2_norm"))


def merged(metrics: DataFrame, by: list[str], seq: str, value: str = "value") -> DataFrame:
    """Merges of what was recorded more than once: first, last, sum, max, min, and the running mean of pairs; nulls don't count.

    In the running mean each value counts half as much as the one after it, the first as much as the second, so it is a
    weighted sum by places, and no task holds a key's history.
    """
    v = F.col(value)
    known = ranked(metrics.where(v.isNotNull()), by, seq, "_r")
    counts = known.groupBy(*by).agg(F.count("*").alias("_n"))
    weight = F.pow(F.lit(0.5), (F.col("_n") - F.greatest(F.col("_r"), F.lit(2)) + 1).cast("double"))
    weight = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(weight)
    met = known.join(counts, by)
    return met.groupBy(*by).agg(F.min_by(v, seq).alias("first"), F.max_by(v, seq).alias("last"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"), F.sum(v * weight).alias("mean"))


def spikes(metrics: DataFrame, by: list[str], step: str, values: list[str], window: int = 128, sigmas: float = 6.0) -> DataFrame:
    """Adds ``spike``: any of the values above the mean of the window before by so many deviations; never before it is full.

    Steps are whole numbers; a series is cut into blocks that carry the window before them.
    """
    return marked_spikes(ranked(metrics, by, step, "_rank"), by, "_rank", values, window, sigmas).drop("_rank")


def marked_spikes(placed: DataFrame, by: list[str], rank: str, values: list[str], window: int, sigmas: float) -> DataFrame:
    """``spikes`` of rows with their places in their series."""
    dealt, block = in_blocks(placed, by, rank, window)
    past = Window.partitionBy(*block).orderBy(rank).rowsBetween(-window, -1)
    found = F.lit(False)
    for value in values:
        sigma = F.stddev_pop(value).over(past)
        above = (F.count(value).over(past) == window) & (sigma >= 1e-10) & (F.col(value) > F.avg(value).over(past) + sigmas * sigma)
        found = found | F.coalesce(above, F.lit(False))
    return dealt.withColumn("spike", found).where("_own").drop("_own", "_block")


def spike_rates(metrics: DataFrame, by: list[str], step: str, rolling: int = 10_000, least: int = 128) -> DataFrame:
    """Adds the share of spikes in the last rows, once there are so many, and in all so far, from the ``least``-th on."""
    hit = F.col("spike").cast("long")
    t = running_sum(ranked(metrics.withColumn("_hit", hit), by, step, "_rank"), by, step, "_hit", "_sum")
    before = t.select(*by, (F.col("_rank") + rolling).alias("_rank"), F.col("_sum").alias("_before"))
    t = t.join(before, [*by, "_rank"], "left")
    share = (F.col("_sum") - F.coalesce("_before", F.lit(0))) / rolling
    return t.withColumn("rolling_rate", F.when(F.col("_rank") >= rolling, share)).withColumn("total_rate", F.when(F.col("_rank") >= least, F.col("_sum") / F.col("_rank"))).drop("_hit", "_sum", "_rank", "_before")


def kept_steps(metrics: DataFrame, by: list[str], step: str, values: list[str], window: int = 128, sigmas: float = 6.0) -> DataFrame:
    """Adds ``keep``: every value within so many sample deviations of the window before, or fewer than half a window recorded."""
    dealt, block = in_blocks(ranked(metrics, by, step, "_rank"), by, "_rank", window)
    past = Window.partitionBy(*block).orderBy("_rank").rowsBetween(-window, -1)
    kept = F.lit(True)
    for value in values:
        active = F.count(value).over(past) + 1 >= window // 2
        inside = F.col(value) - F.avg(value).over(past) <= sigmas * F.stddev_samp(value).over(past)
        kept = kept & (~active | F.coalesce(inside, F.lit(True)))
    return dealt.withColumn("keep", kept).where("_own").drop("_own", "_block", "_rank")


def throughput(steps: DataFrame, by: list[str], step: str, seconds: str, tokens: str, loading: str | None = None, flops: float | None = None, peak: float | None = None) -> DataFrame:
    """Adds seconds since the step before, tokens a second, and the average so far without the first step.

    With the seconds spent ``loading`` also their share of the step; with operations of a token and a device's ``peak``
    a second also the share of it in use. Steps are whole numbers; sums run over blocks of them.
    """
    t = ranked(steps, by, step, "_rank")
    before = t.select(*by, (F.col("_rank") + 1).alias("_rank"), F.col(seconds).alias("_before"))
    t = t.join(before, [*by, "_rank"], "left").withColumn("step_seconds", F.col(seconds) - F.col("_before"))
    counted = F.when(F.col("step_seconds").isNotNull(), F.col(tokens)).otherwise(0)
    t = t.withColumn("_counted", counted).withColumn("_took", F.coalesce("step_seconds", F.lit(0)))
    t = running_sum(running_sum(t, by, "_rank", "_counted", "_tokens"), by, "_rank", "_took", "_seconds")
    t = t.withColumn("tps", F.try_divide(F.col(tokens), F.col("step_seconds"))).withColumn("tps_average", F.when(F.col("_rank") > 1, F.try_divide("_tokens", "_seconds")))
    if loading:
        t = t.withColumn("loading_share", F.try_divide(F.col(loading), F.col("step_seconds")))
    if flops and peak:
        t = t.withColumn("used", F.col("tps") * flops / peak)
    return t.drop("_rank", "_before", "_counted", "_took", "_tokens", "_seconds")


def as_of(rows: DataFrame, schedule: DataFrame, by: list[str], at: str, start: str, columns: list[str], width: int | None = None) -> DataFrame:
    """Rows with the columns of the schedule entry that is in force, nulls included: the one with the latest start up to ``at``.

    Time is cut into blocks (30 days, or ``width`` of numbers): rows see the entries of their block and the last one before
    it, so a key's rows are spread over its blocks. Of entries with one start the one that sorts last holds.
    """
    kind = rows.schema[at].dataType.typeName()
    number = {"date": lambda c: F.unix_date(c), "timestamp": lambda c: F.unix_seconds(c), "timestamp_ntz": lambda c: F.unix_seconds(c.cast("timestamp"))}.get(kind, lambda c: c)
    block = lambda c: F.floor(number(c) / (width or {"date": 30, "timestamp": 30 * 86400, "timestamp_ntz": 30 * 86400}.get(kind, 4096)))
    entry = F.struct(F.col(start).alias("_start"), *(F.col(c).alias(f"_{c}") for c in columns))
    last = schedule.groupBy(*by, block(F.col(start)).alias("_block")).agg(F.max(entry).alias("_last"))
    blocks = last.unionByName(rows.select(*by, block(F.col(at)).alias("_block")).distinct(), allowMissingColumns=True).groupBy(*by, "_block").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*by, "_block", F.max("_last").over(earlier).alias("_carried"))
    left = rows.withColumn("_left", F.lit(True)).withColumn("_at", F.col(at)).withColumn("_block", block(F.col(at)))
    right = schedule.select(*by, F.col(start).alias("_at"), F.lit(False).alias("_left"), entry.alias("_entry"), block(F.col(start)).alias("_block"))
    upto = Window.partitionBy(*by, "_block").orderBy("_at", "_left").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right, allowMissingColumns=True).withColumn("_found", F.max("_entry").over(upto)).where("_left")
    found = found.join(carried, [*by, "_block"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.withColumns({c: F.col(f"_found._{c}") for c in columns}).drop("_left", "_at", "_block", "_entry", "_found", "_carried")


def load_balance(rows: DataFrame, expert: str) -> DataFrame:
    """Largest share of rows over the mean share of experts."""
    counts = rows.groupBy(expert).count()
    return counts.agg(F.count("*").alias("experts"), F.sum("count").alias("rows"), (F.max("count") / F.avg("count")).alias("imbalance"))


def histogram(rows: DataFrame, expert: str, experts: int) -> DataFrame:
    """Rows of each expert, 0 for those without any."""
    counts = rows.groupBy(F.col(expert).cast("long").alias("expert")).agg(F.count("*").alias("rows"))
    every = rows.sparkSession.range(experts).withColumnRenamed("id", "expert")
    return every.join(counts, "expert", "left").select("expert", F.coalesce("rows", F.lit(0)).alias("rows"))


def balancing_loss(scores: DataFrame, k: int, values: str = "scores", by: list[str] | None = None) -> DataFrame:
    """Load-balancing loss of rows of router scores: experts over ``k``, times the sum over experts of mean score and share of picks.

    With ``by`` (an instance) the loss is taken for each and summed, over the rows of all.
    """
    by = by or []
    picked = scores.withColumn("_picked", top_experts(F.col(values), k))
    each = picked.select(*by, F.posexplode(F.transform(values, lambda x, i: F.struct(x.cast("double").alias("x"), F.array_contains("_picked", i).cast("long").alias("p")))).alias("expert", "v"))
    means = each.groupBy(*by, "expert").agg(F.avg("v.x").alias("_mean"), F.sum("v.p").alias("_picks"))
    total = means.agg((F.max("expert") + 1).alias("_experts"), (F.sum("_picks") / k).alias("_rows"), F.sum(F.col("_mean") * F.col("_picks")).alias("_dot"))
    return total.select((F.col("_experts") / k * F.col("_dot") / F.col("_rows")).alias("loss"))


def router_z_loss(logits: DataFrame, values: str = "logits") -> DataFrame:
    return logits.agg(F.avg(F.pow(log_sum_exp(F.col(values)), F.lit(2.0))).alias("loss"))


def cross_entropy(rows: DataFrame, logits: str, label: str, ignore: int = -100, z: float | None = None) -> DataFrame:
    """Mean loss over rows whose label isn't ignored, NaN without any; with ``z`` also the mean squared log-sum-exp times it."""
    total = log_sum_exp(F.col(logits))
    kept = F.col(label) != ignore
    loss = F.when(kept, total - F.get(F.col(logits), F.col(label).cast("int")).cast("double"))
    found = [F.coalesce(F.avg(loss), F.lit(NAN)).alias("loss"), F.count_if(kept).alias("rows")]
    if z is not None:
        found.append(F.coalesce(F.avg(F.when(kept, F.pow(total, F.lit(2.0)))) * z, F.lit(NAN)).alias("z_loss"))
    return rows.agg(*found)


def spread(rows: DataFrame, values: str, by: list[str] | None = None) -> DataFrame:
    """Mean over instances of their mean and unbiased variance, and the largest absolute value of all; for arrays of numbers."""
    x = F.transform(values, lambda v: v.cast("double"))
    n = F.size(values)
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), n)
    squares = let(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))
    largest = F.array_max(F.transform(x, F.abs))
    return rows.groupBy(*(by or [])).agg(F.avg(mean).alias("mean"), F.avg(F.try_divide(squares, n - 1)).alias("var"), F.coalesce(F.max(largest), F.lit(0.0)).alias("max"))


def latest(metrics: DataFrame, pattern: str = "*", name: str = "name", step: str = "step", value: str = "value") -> DataFrame:
    """Newest value of each metric whose name fits a pattern."""
    return metrics.where(name_matches(F.col(name), pattern)).groupBy(name).agg(F.max(step).alias(step), F.max_by(value, step).alias(value))


def first_of(files: DataFrame, by: list[str], priority: str) -> DataFrame:
    """Of what several folders hold, the rows of the first folder that has any, for each ``by``."""
    best = files.groupBy(*by).agg(F.min(priority).alias("_best"))
    return files.join(best, by).where(F.col(priority) == F.col("_best")).drop("_best")


def stepped(metrics: DataFrame, start: int, stop: int, step: str = "step") -> DataFrame:
    return metrics.where((F.col(step) >= start) & (F.col(step) < stop))


def perplexity(loss: Column, most: float = 10.0) -> Column:
    """Of a finite loss below a bound, null otherwise."""
    return F.when(~F.isnan(loss) & (F.abs(loss) != float("inf")) & (loss < most), F.exp(loss))


def ladder_table(runs: dict[str, DataFrame], facts: dict[str, dict]) -> DataFrame:
    """Metrics of several runs as one table: the run's name and facts beside them, nulls where one lacks a column."""
    named = [df.withColumns({"run": F.lit(name)} | {k: F.lit(v) for k, v in facts[name].items()}) for name, df in runs.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def speeds(evaluators: DataFrame, name: str, seconds: str) -> DataFrame:
    """Evaluators from the fastest on (``place``), with their share of the time; a row an evaluator."""
    share = F.col(seconds) / F.sum(seconds).over(Window.partitionBy())
    return evaluators.withColumn("place", F.row_number().over(Window.orderBy(seconds, name))).withColumn("share", share)


def trailing_mean(rows: DataFrame, order: str, value: str, last: int, name: str) -> DataFrame:
    """Adds the mean of this and the rows before it, ``last`` in all, in the order of a dense whole number."""
    dealt, block = in_blocks(rows, [], order, last - 1)
    return dealt.withColumn(name, F.avg(value).over(Window.partitionBy(*block).orderBy(order).rowsBetween(1 - last, 0))).where("_own").drop("_own", "_block")


def window_starts(steps: DataFrame, last: int, length: int, step: str = "step") -> DataFrame:
    """Where averaging windows of ``length`` steps that end at given steps begin, overlapping ones joined; a row a window."""
    t = steps.select((F.col(step) - length + 1).alias("low"), F.col(step).alias("high")).where(F.col("high") <= last)
    ordered = Window.orderBy("low")
    reach = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = t.withColumn("_new", F.coalesce((F.col("low") > reach + 1).cast("int"), F.lit(1)))
    return marked.withColumn("_g", F.sum("_new").over(ordered)).groupBy("_g").agg(F.min("low").alias("start"), F.max("high").alias("end")).drop("_g")


def compared(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys of two configurations: ``only_a``, ``only_b``, ``differs`` or ``equal``, with both values."""
    both = a.select(F.col(key), F.col(value).alias("a"), F.lit(True).alias("_in_a")).join(b.select(F.col(key), F.col(value).alias("b"), F.lit(True).alias("_in_b")), key, "full")
    state = F.when(F.col("_in_b").isNull(), "only_a").when(F.col("_in_a").isNull(), "only_b").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("differs")
    return both.select(key, "a", "b", state.alias("state"))


def step_metrics(metrics: DataFrame, every: int | None = None, fixed: list[int] | None = None, pattern: str = "*", name: str = "name", step: str = "step", value: str = "value") -> DataFrame:
    """Rows (step, metrics), a map of each metric's newest value up to that step, at every so many steps, at fixed ones, and at the last.

    Only metrics whose name fits the pattern count. Steps of a snapshot are few beside the metrics' rows: each row is carried
    to the snapshots from its step up to the next row of its metric, found by a join on the metric's own intervals.
    """
    rows = metrics.where(name_matches(F.col(name), pattern)).groupBy(name, step).agg(F.max(value).alias("value"))
    lasts = metrics.agg(F.max(step)).scalar()
    chosen = F.lit(False) if every is None else F.col(step) % every == 0
    chosen |= F.col(step).isin(fixed or [])
    shots = metrics.select(step).distinct().where(chosen | (F.col(step) == lasts)).withColumnRenamed(step, "_at")
    following = F.lead(step).over(Window.partitionBy(name).orderBy(step))
    held = rows.withColumns({"_last": F.coalesce(following - 1, lasts)})
    met = within(shots, "_at", held, [], step, "_last")
    return met.groupBy(F.col("_at").alias(step)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "value")))).alias("metrics"))  # a snapshot is one row


def write_metrics(snapshots: DataFrame, folder: str, step: str = "step", metrics: str = "metrics") -> None:
    """A JSON file for each snapshot's step, in a folder of its own: metrics_step=N."""
    snapshots.select(F.col(step).alias("metrics_step"), F.to_json(metrics).alias("value")).repartition("metrics_step").write.partitionBy("metrics_step").mode("overwrite").text(folder)


def read_metrics(spark: SparkSession, folders: list[str], prefix: str | None = None) -> DataFrame:
    """Rows (folder, step, name, value) of the metric files of several folders; of a step that more than one has, the first folder's.

    Folder and step come from the files' own paths. With a prefix, only metrics whose names begin with it.
    """
    path = F.col("_metadata.file_path")
    parts = []
    for k, folder in enumerate(folders):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
        parts.append(files.select(F.lit(k).alias("folder"), F.regexp_extract(path, r"metrics_step=(\d+)/", 1).cast("long").alias("step"), F.from_json("value", "map<string,double>").alias("metrics")))
    first = first_of(functools.reduce(DataFrame.unionByName, parts), ["step"], "folder")
    rows = first.select("folder", "step", F.explode("metrics").alias("name", "value"))
    return rows if prefix is None else with_prefix(rows, prefix)


def with_prefix(metrics: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    return metrics.where(F.col(name).startswith(prefix))


def checkpoint_table(metrics: DataFrame, run: str, batch_tokens: int, names: list[str], facts: dict | None = None) -> DataFrame:
    """A row for each step of a run, with its tokens, the run's facts, and a column for each metric asked for; null where it lacks."""
    wide = metrics.groupBy("step").pivot("name", names).agg(F.first("value"))
    known = {"run": F.lit(run), "tokens": (F.col("step") * batch_tokens).cast("long")} | {k: F.lit(v) for k, v in (facts or {}).items()}
    return wide.withColumns(known)
