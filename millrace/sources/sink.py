"""Raw files of token ids: written in parts by many tasks, and moved to their places when the job is whole.

A stream is cut into parts of about so many ids by the places of its rows, so one that holds a third of a corpus is written
by as many tasks as it has parts. Parts are named by the place of their first id; in the order of their names they are the
stream. Tasks write to a folder of the job; the driver moves what finished tasks report, after it has checked that parts
lie side by side, and deletes the rest. A job that fails leaves nothing, and a task that runs twice leaves one part.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from millrace.operators.documents import export_statistics, lengths_of, offsets, tokenized
from millrace.operators.intervals import within
from millrace.sources.shards import file_system

#: Ids of a part.
PART = 1 << 26


@dataclass
class Parts(WriterCommitMessage):
    """What a task wrote: (stream, place of the first id, ids, path)."""

    found: list[tuple[str, int, int, str]]


class TokenParts(DataSource):
    """Sink of rows (stream, part, start, ids), sorted by these within a task. Options: ``folder``, ``width``."""

    @classmethod
    def name(cls) -> str:
        return "token_parts"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _Writer(self.options["folder"].rstrip("/"), self.options["width"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, width: str):
        self.folder, self.kind, self.own = folder, np.dtype(f"<{width}"), f"{folder}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Parts:
        system, place = file_system(self.own)
        system.create_dir(place, recursive=True)
        found: list[list] = []
        out, current, most = None, None, np.iinfo(self.kind).max
        try:
            for batch in iterator:
                names = batch.schema.names
                stream, part, start, ids = (batch.column(names.index(c)) for c in ("stream", "part", "start", "ids"))
                keys = list(zip(stream.to_pylist(), part.to_pylist()))
                cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
                for low, high in zip(cuts, [*cuts[1:], len(keys)]):
                    values = ids.slice(low, high - low).flatten().to_numpy(zero_copy_only=False)
                    if len(values) and not 0 <= values.min() <= values.max() <= most:
                        raise ValueError(f"ids don't fit {self.kind}")
                    if keys[low] != current:
                        if out is not None:
                            out.close()
                        current, path = keys[low], f"{self.own}/{uuid.uuid4().hex}"
                        out = system.open_output_stream(file_system(path)[1])
                        found.append([keys[low][0], start[low].as_py(), 0, path])
                    out.write(values.astype(self.kind).tobytes())
                    found[-1][2] += len(values)
        finally:
            if out is not None:
                out.close()
        return Parts([tuple(x) for x in found])

    def commit(self, messages) -> None:
        system, place = file_system(self.folder)
        parts = sorted(x for m in messages if m is not None for x in m.found)
        end = {}
        for stream, start, n, _ in parts:
            if end.get(stream, 0) != start:
                raise ValueError(f"parts of {stream} don't lie side by side: {start} after {end.get(stream, 0)}")
            end[stream] = start + n
        for stream in end:
            system.create_dir(f"{place}/{quote(stream)}", recursive=True)
        for stream, start, _, path in parts:
            system.move(file_system(path)[1], f"{place}/{quote(stream)}/{start:018d}.npy")
        self.abort([])

    def abort(self, messages) -> None:
        system, place = file_system(self.own)
        system.delete_dir_contents(place, missing_dir_ok=True)
        if system.get_file_info(place).type.name == "Directory":
            system.delete_dir(place)


def write_tokens(streams: DataFrame, by: str, order: str, folder: str, width: str, ids: str = "ids", part: int = PART) -> DataFrame:
    """Write the ids of each ``by`` as a stream of parts, its rows in ``order``; returns (by, path, tokens), a row a stream.

    Places come from sums of lengths alone. They say at which rows parts begin; each row finds its part by its order, so
    ids are shuffled once, to their parts. ``order`` is a whole number that no two rows of a ``by`` share; ``n``, if there,
    is taken as the number of ids.
    """
    spark = streams.sparkSession
    sized = streams if "n" in streams.columns else streams.withColumn("n", F.size(ids).cast("long"))
    placed = offsets(sized.select(by, order, "n").where("n > 0"), [by], order).withColumn("part", F.expr(f"start div {part}"))
    begins = placed.groupBy(by, "part").agg(F.min(order).alias("low"), F.max(order).alias("last"), F.min("start").alias("base"))
    rows = within(sized.where("n > 0").select(by, order, F.col(ids).alias("ids")), order, begins, [by])
    dealt = rows.repartition(by, "part").sortWithinPartitions(by, "part", order)
    name = F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("stream")
    spark.dataSource.register(TokenParts)
    dealt.select(name, "part", F.col("base").alias("start"), F.col("ids").cast("array<bigint>").alias("ids")).write.format("token_parts").option("folder", folder).option("width", width).mode("append").save()
    totals = sized.groupBy(by).agg(F.sum("n").alias("tokens")).where("tokens > 0")
    return totals.select(by, F.concat(F.lit(f"{folder.rstrip('/')}/"), F.coalesce(F.col(by).cast("string"), F.lit("null"))).alias("path"), "tokens")


def write_bounds(docs: DataFrame, by: str, folder: str) -> None:
    """Bounds of documents (by, start, end) as gzip CSV, a folder for each ``by``, by as many tasks as there are ranges of them."""
    docs.select(by, "start", "end").repartitionByRange(by, "start").sortWithinPartitions(by, "start").write.partitionBy(by).option("compression", "gzip").csv(folder)


def export(texts: DataFrame, by: str, order: str, folder: str, width: str, text: str = "text", most: int | None = None, part: int = PART) -> DataFrame:
    """Write texts as ids: a stream of parts for each ``by``, its documents' bounds, and statistics as JSON; returns the streams."""
    bounds = offsets(lengths_of(texts.select(by, order, text), text), [by], order)
    write_bounds(bounds, by, f"{folder}/bounds")
    export_statistics(texts, by, text).write.json(f"{folder}/statistics")
    return write_tokens(tokenized(texts.select(by, order, text), text, most=most), by, order, f"{folder}/tokens", width, part=part)


def dump_batch(plan: DataFrame, rows: DataFrame, on: str, batch: int, folder: str) -> DataFrame:
    """Write the rows of one batch of a plan, in the order of their slots; returns what was written."""
    plan.where(F.col("batch") == batch).join(rows, on).orderBy("slot").write.parquet(folder)
    return plan.sparkSession.read.parquet(folder)
