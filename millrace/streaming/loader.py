"""A loader as a stream: batches of a plan come in order, from where a checkpoint says, until a duration is due.

The stream's offset is a place in the epoch's order of instances, which Spark keeps in the checkpoint; each micro-batch takes
the next so many places and joins them to the plan, so any batch can be made again from its number alone. A cursor beside
the checkpoint says what is read, in which order, and how far it got; a stream that goes on with other sources is refused.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.loading import Cursor
from millrace.sources.shared import exists, read_text, write_text


def places(spark: SparkSession, each: int) -> DataFrame:
    """A stream of places (position) from 0, so many in a micro-batch."""
    parts = max(1, min(each, spark.sparkContext.defaultParallelism))
    stream = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=each, numPartitions=parts, startTimestamp=0).load()
    return stream.select(F.col("value").alias("position"))


def run(plan: DataFrame, cursor: Cursor, instances: int, folder: str, batches: int = 1, stop: int | None = None, each: Callable[[DataFrame], DataFrame] | None = None, wait: float = 600.0) -> Cursor:
    """Write the rows of a plan (position, ...) batch after batch to ``folder``/rows, and return where it stopped.

    A batch has ``instances`` rows; a micro-batch has ``batches`` of them, and the stream ends after batch ``stop`` or at the
    last whole one of the plan. A second call with the same folder goes on after the last micro-batch that was written; a
    cursor of other sources, of another seed or of other batches is an error. A micro-batch that runs again replaces its rows.
    """
    spark = plan.sparkSession
    at = f"{folder}/cursor.json"
    if exists(spark, at):
        saved = json.loads(read_text(spark, at))
        if saved["seed"] != cursor.seed or saved["batch_tokens"] != cursor.batch_tokens:
            raise ValueError("the saved state has another seed or other batches")
        cursor = cursor.restored(saved)
    whole = plan.agg(F.count("*")).first()[0] // instances
    last = whole if stop is None else min(whole, stop)
    if cursor.batches >= last:
        return cursor
    done: list[Cursor] = [cursor]
    ended: list[bool] = []

    def write(batch: DataFrame, number: int) -> None:
        first = number * batches
        if first >= last:
            ended.append(True)
            raise StopIteration("the duration is due")  # so that Spark doesn't count this micro-batch as done
        rows = batch.where(F.col("position") < last * instances).join(plan, "position")
        rows = rows.withColumns({"batch": F.floor(F.col("position") / instances), "slot": (F.col("position") % instances).cast("int")}).drop("position")
        (each(rows) if each else rows).write.mode("overwrite").parquet(f"{folder}/rows/part={number}")
        through = max(done[-1].batches, min(last, first + batches))
        now = replace(done[0], batches=through, tokens=through * cursor.batch_tokens)
        write_text(spark, at, json.dumps(now.state()))
        done.append(now)
        if last < first + batches:
            ended.append(True)
            raise StopIteration("the duration is due within a micro-batch")  # which is made whole by the next run

    query = places(spark, instances * batches).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        until = time.time() + wait
        while query.isActive and done[-1].batches < last and time.time() < until:
            time.sleep(0.05)
        if query.exception() and not ended:
            raise query.exception()
        if done[-1].batches < last:
            raise TimeoutError(f"{done[-1].batches} of {last} batches in {wait} seconds")
    finally:
        query.stop()
    return done[-1]
