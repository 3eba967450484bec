"""Sizes and samples of mixtures: ratios, quotas, repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sums import running_sum


def sample_sizes(sources: DataFrame, target: float | None = None, size: str = "size", ratio: str = "ratio", repetition: str = "repetition") -> DataFrame:
    """Adds ``sample``: tokens to take of each source, so ratios hold and no source is repeated more often than allowed.

    Ratios are scaled to sum to one. Without a target all tokens are asked for; what the scarcest source allows scales
    every source alike.
    """
    everything = Window.partitionBy()  # a row a source
    t = sources.withColumn("_target", F.lit(float(target)) if target is not None else F.sum(size).over(everything).cast("double"))
    t = t.withColumn("_want", F.col("_target") * F.col(ratio) / F.sum(ratio).over(everything))
    t = t.withColumn("_use", F.least(F.col(repetition).cast("double"), F.greatest(F.col("_want") / F.col(size), F.lit(1.0))))
    factor = F.least(F.lit(1.0), F.min(F.col(size) * F.col("_use") / F.col("_want")).over(everything))
    return t.withColumn("sample", F.floor(F.col("_want") * factor)).drop("_target", "_want", "_use")


def apportion(paths: DataFrame, requested: int | Column, size: int, order: str, tokens: str = "tokens", most: str = "max_tokens") -> DataFrame:
    """Adds ``instances``: whole instances of each path that sum to ``requested`` where capacities allow.

    Floors first; what is missing is dealt evenly over paths with room, and the last few by the largest remainders,
    the later path first among equals. ``shortfall`` is what stays missing.
    """
    all_ = Window.partitionBy()  # a row a path of the mixture's plan
    requested = requested if isinstance(requested, Column) else F.lit(requested)
    t = paths.withColumn("_cap", F.expr(f"{most} div {size}")).withColumn("_base", F.least(F.expr(f"{tokens} div {size}"), F.col("_cap")))
    t = t.withColumn("_room", F.col("_base") < F.col("_cap")).withColumn("_remainder", F.when(F.col("_room"), F.col(tokens) % size).otherwise(0))
    missing = F.greatest(requested - F.sum("_base").over(all_), F.lit(0))
    eligible = F.count_if("_room").over(all_)
    t = t.withColumn("_even", F.when(F.col("_room"), F.floor(missing / F.greatest(eligible, F.lit(1)))).otherwise(0))
    t = t.withColumn("_base", F.col("_base") + F.least("_even", F.col("_cap") - F.col("_base")))
    t = t.withColumn("_open", F.col("_room") & (F.col("_base") < F.col("_cap")))
    t = t.withColumn("_missing", F.greatest(requested - F.sum("_base").over(all_), F.lit(0)))
    t = t.withColumn("_rank", F.row_number().over(Window.partitionBy("_open").orderBy(F.desc("_remainder"), F.desc(order))))
    t = t.withColumn("instances", F.col("_base") + (F.col("_open") & (F.col("_rank") <= F.col("_missing"))).cast("long"))
    t = t.withColumn("shortfall", F.greatest(requested - F.sum("instances").over(all_), F.lit(0)))
    return t.drop("_cap", "_base", "_room", "_remainder", "_even", "_open", "_missing", "_rank")


def mixture_plan(sources: DataFrame, files: DataFrame, requested: Column, batch: int, size: int) -> DataFrame:
    """Passes over the files of a mixture's sources, with the whole instances that each contributes.

    ``sources``: source, rank (their order), ratio, repetition, fraction. ``files``: source, path, path_idx, tokens.
    ``requested`` tokens (``population`` is a source's) are brought to whole batches. A source that is asked for more than
    it has goes over its files in several passes; one that may not give enough is an error. Rows: source, path, pass, idx,
    population, needed, max_tokens, instances, tokens, shortfall; the plan has a row a file and pass.
    """
    t = sources.join(files.groupBy("source").agg(F.sum("tokens").alias("population")), "source").withColumn("_requested", requested.cast("long"))
    needed = F.floor(F.col("_requested") * F.col("ratio"))
    most = F.floor(F.col("population") * F.col("fraction") * F.col("repetition"))
    short = F.raise_error(F.concat(F.lit("too few tokens in source "), "source", F.lit(": "), most.cast("string"), F.lit(" < "), needed.cast("string")))
    t = t.withColumn("needed", F.when(most >= needed, needed).otherwise(short.cast("long")))
    take = F.col("needed") / F.col("population")
    t = t.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(take).cast("int") - 1, F.lit(0))))).withColumn("_share", F.least(F.lit(1.0), take - F.col("pass")))
    paths = t.join(files, "source").withColumn("max_tokens", F.col("tokens")).withColumn("tokens", F.ceil(F.col("max_tokens") * F.col("_share")).cast("long"))
    paths = paths.withColumn("idx", F.row_number().over(Window.orderBy("rank", "pass", "path_idx")) - 1)  # a row a file and pass
    instances = F.ceil(F.col("_requested") / batch) * (batch // size)
    found = apportion(paths, instances, size, "idx", "tokens", "max_tokens")
    return found.select("source", "path", "pass", "idx", "population", "needed", "max_tokens", "instances", (F.col("instances") * size).alias("tokens"), "shortfall")


def mixture_report(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: population, tokens, its share of all, the share asked for, passes, and the difference."""
    by = plan.groupBy("source").agg(F.max("population").alias("population"), F.sum("tokens").alias("tokens"), (F.max("pass") + 1).alias("passes"))
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())  # a row a source
    found = by.join(sources.select("source", F.col("ratio").alias("target")), "source").withColumn("share", share)
    return found.withColumn("difference", F.abs(F.col("share") - F.col("target")))


def mixture_instances(chunks: DataFrame, plan: DataFrame, on: list[str], instance: str = "instance") -> DataFrame:
    """Instances of a mixture: the first of each file, in every pass, as many as the plan says; adds ``index`` over all passes."""
    base = F.coalesce(F.sum("instances").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file and pass
    quota = plan.withColumn("_base", base).select(*on, "idx", "instances", "_base")
    return chunks.join(quota, on).where(F.col(instance) < F.col("instances")).withColumn("index", F.col("_base") + F.col(instance)).drop("_base", "instances")


def sample_documents(docs: DataFrame, most: Column, position: str, n: str = "n") -> DataFrame:
    """Whole copies of all documents as often as they fit into ``most`` tokens, then the first ones whose sum still fits.

    Adds ``copy``. ``most`` may refer to ``total``, the tokens of all. ``position`` is a dense order; sums run over its
    blocks, and the totals of blocks over blocks of theirs.
    """
    summed = running_sum(docs.withColumn("_all", F.lit(0)), ["_all"], position, n, "_sum")
    summed = summed.withColumn("total", docs.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()).withColumn("_most", most.cast("long"))
    whole = F.expr("_most div total")
    copies = whole + (F.col("_sum") <= F.col("_most") - whole * F.col("total")).cast("long")
    return summed.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(-1).cast("long"), copies - 1), lambda c: c >= 0))).withColumn("copy", F.col("copy").cast("int")).drop("_all", "_sum", "_most", "total")


def token_slices(docs: DataFrame, low: int, high: int) -> DataFrame:
    """Documents (start, end, ids) cut to the tokens [low, high) of their stream."""
    start, end = F.greatest("start", F.lit(low)), F.least("end", F.lit(high))
    cut = docs.where((F.col("start") < high) & (F.col("end") > low))
    piece = F.slice("ids", (start - F.col("start") + 1).cast("int"), (end - start).cast("int"))
    return cut.withColumn("ids", piece).withColumn("_s", start).withColumn("end", end).withColumn("start", F.col("_s")).drop("_s")
