"""Metric streams: replay in bounded batches, and spikes found with a window of state for each series."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.metrics import marked_spikes
from millrace.operators.sums import sorted_sums
from millrace.sources.shared import remove, shared_dir


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a table, so many in a batch."""
    batch = spark.read.parquet(path)
    files = batch.inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[1])
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    if single:  # a stream reads folders
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


@dataclass(frozen=True)
class Spikes:
    """A stream and how its batches are folded into rows (by, step, spike)."""

    stream: DataFrame
    by: str
    step: str
    value: str
    window: int
    sigmas: float

    def fold(self, batch: DataFrame, past: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """A batch's rows with ``spike``, and what the next batch needs: the last window of each series.

        Rows of a batch, however many a series has, are sorted over ranges and dealt to blocks that carry the window before
        them; the state's rows come before all of them.
        """
        rows = batch.select(self.by, self.step, F.col(self.value).cast("double").alias("value"))
        placed = sorted_sums(rows.withColumn("_one", F.lit(1).cast("long")), [self.by], [self.step, "value"], {"_rank": "_one"}).drop("_one")
        placed = placed.withColumns({"_rank": F.col("_rank") + self.window, "_new": F.lit(True)})
        whole = placed if past is None else placed.unionByName(past.withColumn("_new", F.lit(False)))
        found = marked_spikes(whole, [self.by], "_rank", ["value"], self.window, self.sigmas).where("_new").select(self.by, self.step, "spike")
        last = whole.groupBy(self.by).agg(F.max("_rank").alias("_last"))
        kept = whole.join(last, self.by).where(F.col("_rank") > F.col("_last") - self.window)
        # of a series without new rows the state stays; ranks end at the window's width
        state = kept.select(self.by, self.step, "value", (F.col("_rank") - F.col("_last") + self.window).alias("_rank"))
        return found, state


def spikes(stream: DataFrame, by: str, step: str, value: str, window: int, sigmas: float) -> Spikes:
    """Rows (by, step, spike) of a stream whose batches come in the order of ``step``; state is one window a series.

    Rows of a batch may come in any order. A late row, one that comes after rows of a later step in an earlier batch, is
    taken as the next one of its series. Series are told apart by ``by``, which isn't null.
    """
    return Spikes(stream, by, step, value, window, sigmas)


def drained(found: Spikes, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote to the folder that executors share.

    A folder that is given goes on where it stopped. Rows and state are written under the batch's number, so a batch that
    runs again replaces what it wrote; states of batches before the last are removed.
    """
    spark = found.stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    kind = found.stream.schema
    state = f"`{found.by}` {kind[found.by].dataType.simpleString()}, `{found.step}` {kind[found.step].dataType.simpleString()}, value double, _rank long"

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        past = session.read.schema(state).parquet(f"{folder}/state/{number - 1}") if number else None
        rows, new = found.fold(batch, past)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        new.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        if number > 1:
            remove(session, f"{folder}/state/{number - 2}")

    query = found.stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    output = f"`{found.by}` {kind[found.by].dataType.simpleString()}, `{found.step}` {kind[found.step].dataType.simpleString()}, spike boolean, batch long"
    return spark.read.schema(output).parquet(f"{folder}/rows").drop("batch")
