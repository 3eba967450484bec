"""Values meet the intervals that hold them: a join by the cells of a grid, without a nested loop or a broadcast of all intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(rows: DataFrame, value: str, intervals: DataFrame, by: list[str], low: str = "low", last: str = "last") -> DataFrame:
    """Rows joined with the intervals [low, last] of whole numbers of the same ``by`` that hold their value.

    Cells are as wide as intervals are on average, so all intervals together lie in at most three times as many cells as
    there are of them, however lengths differ. Rows whose value no interval holds are left out; nulls in ``by`` are equal.
    """
    wide = intervals.agg(F.greatest(F.ceil(F.avg(F.col(last).cast("double") - F.col(low))), F.lit(1).cast("long"))).scalar()
    cell = lambda x: F.floor(F.col(x).cast("double") / wide)  # noqa: E731  monotone, so ends of an interval bound its values' cells
    keys = [f"_by{k}" for k in range(len(by))]
    held = intervals.where(F.col(low) <= F.col(last)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(last))))
    held = held.withColumnsRenamed(dict(zip(by, keys)))
    asked = rows.withColumn("_value_cell", cell(value))
    same = F.col("_value_cell") == F.col("_cell")
    for a, b in zip(by, keys):
        same &= F.col(a).eqNullSafe(F.col(b))
    return asked.join(held, same).where(F.col(value).between(F.col(low), F.col(last))).drop("_value_cell", "_cell", *keys)
