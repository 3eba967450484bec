"""Shuffles, strategies and batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sums import global_position, hash_order


def shuffled(df: DataFrame, index: str, seed: int, epoch: int, chunk: int = 1) -> DataFrame:
    """Adds ``position``: a shuffle of a dense index in which runs of ``chunk`` stay together.

    Chunks are ordered by a hash, so the order depends neither on partitions nor on the length of instances. Rows and their
    chunks both grow with the input, so neither is broadcast, however small the planner takes them to be.
    """
    if chunk == 1:
        return global_position(df.withColumn("_key", hash_order(seed, epoch, F.col(index))), "_key", index).drop("_key")
    units = df.select(F.expr(f"`{index}` div {chunk}").alias("_unit")).distinct()
    placed = global_position(units.withColumn("_key", hash_order(seed, epoch, F.col("_unit"))), "_key", "_unit", "_place").drop("_key")
    joined = df.withColumn("_unit", F.expr(f"`{index}` div {chunk}")).join(placed.hint("merge"), "_unit")
    return joined.withColumn("position", F.col("_place") * chunk + F.col(index) % chunk).drop("_unit", "_place")


def interleaved_sources(df: DataFrame, source: str, rank: str) -> DataFrame:
    """Position of a row by turns over sources, in the order of their names, each cut to the rows of the shortest."""
    sizes = df.groupBy(source).count()
    everything = Window.partitionBy()  # a row a source
    plan = sizes.select(source, F.min("count").over(everything).alias("_least"), F.count("*").over(everything).alias("_all"), (F.row_number().over(Window.orderBy(source)) - 1).alias("_k"))
    placed = df.join(plan, source).where(F.col(rank) < F.col("_least"))
    return placed.withColumn("position", F.col(rank) * F.col("_all") + F.col("_k")).drop("_least", "_all", "_k")


def concatenated_sources(df: DataFrame, source: str, position: str) -> DataFrame:
    """Position of a row, sources one after another in the order of their names, each in the order it has (shuffled or not)."""
    sizes = df.groupBy(source).agg(F.count("*").alias("_n"))
    before = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    bases = sizes.select(source, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return df.join(bases, source).withColumn("position", F.col("_base") + F.col(position)).drop("_base")


def epoch_sources(sources: DataFrame, number: str, each: int, epoch: int) -> DataFrame:
    """The sources (numbered from 0) of an epoch: groups of ``each`` by turns."""
    groups = F.floor(F.count("*").over(Window.partitionBy()) / each)  # a row a source
    return sources.withColumn("_groups", groups).where(F.floor(F.col(number) / each) == (epoch - 1) % F.col("_groups")).drop("_groups")


def batches(df: DataFrame, size: int, world: int, position: str = "position") -> DataFrame:
    """Adds batch, slot and rank; slots go to ranks by turns. The incomplete last batch is dropped."""
    total = df.agg(F.count("*")).scalar()
    cut = df.withColumn("_total", total).where(F.col(position) < F.col("_total") - F.col("_total") % size).drop("_total")
    return cut.withColumn("batch", F.expr(f"{position} div {size}")).withColumn("slot", F.col(position) % size).withColumn("rank", (F.col(position) % size) % world)


def bucket_batches(buckets: DataFrame, tokens: int, length: str = "length") -> DataFrame:
    """Per bucket of instance lengths: instances, instances of a batch, and whole batches."""
    per = F.expr(f"{tokens} div {length}")
    sizes = buckets.groupBy(length).agg(F.count("*").alias("instances"))
    return sizes.withColumn("batch_instances", per).withColumn("batches", F.expr("instances div batch_instances"))


def near_equal(count: int, buckets: DataFrame, bucket: str) -> DataFrame:
    """Adds ``size``: near-equal parts of ``count``, larger ones first, for buckets numbered from 0."""
    n = F.count("*").over(Window.partitionBy())
    return buckets.withColumn("size", F.floor(F.lit(count) / n) + (F.col(bucket) < F.lit(count) % n).cast("long"))


def restored(plan: DataFrame, tokens: int, batch_tokens: int) -> DataFrame:
    """The batches still to come after a number of processed tokens."""
    return plan.where(F.col("batch") >= tokens // batch_tokens)
