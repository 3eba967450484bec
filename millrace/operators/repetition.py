"""Periodic repetition within sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MOST_PERIOD, LEAST_TIMES, MOST_TIMES = 13, 3, 32


def periodic_runs(ids: np.ndarray, least: int = 1, most: int = MOST_PERIOD) -> list[tuple[int, int, int, int]]:
    """Runs (start, end, period, times) of at least three repeats of a period, which is a third of the sequence at most."""
    out = []
    for p in range(least, min(most, len(ids) // LEAST_TIMES) + 1):
        same = np.r_[False, ids[p:] == ids[:-p], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if (times := (b - a + p) // p) >= LEAST_TIMES:
                out.append((a, b + p, p, times))
    return out


def repetition(docs: DataFrame, ids: str = "ids", least: int = 1, most: int = MOST_PERIOD, limit: int = MOST_TIMES) -> DataFrame:
    """Adds ``runs``, ``most_times`` (0 without runs) and ``instance_mask``, false where a run repeats ``limit`` times or more."""
    added = [T.StructField("runs", T.LongType()), T.StructField("most_times", T.LongType()), T.StructField("instance_mask", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    place = docs.columns.index(ids)

    def run(batches):
        for batch in batches:
            found = [periodic_runs(np.asarray(x.values), least, most) if x.is_valid else [] for x in batch.column(place)]
            times = [max((r[3] for r in f), default=0) for f in found]
            arrays = [pa.array(map(len, found), pa.int64()), pa.array(times, pa.int64()), pa.array([t < limit for t in times])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.names)

    return docs.mapInArrow(run, schema)
