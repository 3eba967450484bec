"""Running sums and global positions that no single task computes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import hash_order  # noqa: F401
from millrace.sources.shared import shared_dir

#: Width of the blocks of an order column, and hex digits of a hash that make a bucket.
BLOCK, DIGITS = 4096, 3
#: Bytes of input for each bucket of hashes.
BUCKET = 64 << 20


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str, block: int = BLOCK, levels: int = 2) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same ``by`` up to this one in the order of a whole number.

    Blocks of the order are summed first; their totals are summed in the same way, in blocks of blocks, and each row adds
    the rows of its own block. A group that holds a third of all rows is spread over its blocks.
    """
    upto = Window.partitionBy(*by, *(["_block"] if levels else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if not levels:
        return df.withColumn(name, F.sum(value).over(upto))
    cut = df.withColumn("_block", F.expr(f"`{order}` div {block}"))
    totals = cut.groupBy(*by, "_block").agg(F.sum(value).alias("_total")).withColumnRenamed("_block", "_at")
    bases = running_sum(totals, by, "_at", "_total", "_upto", block, levels - 1).select(*by, F.col("_at").alias("_block"), (F.col("_upto") - F.col("_total")).alias("_base"))
    summed = cut.withColumn("_inner", F.sum(value).over(upto))
    return summed.join(bases, [*by, "_block"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_block", "_base", "_inner")


def sorted_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each name, the sum of its value over the rows of the same ``by`` up to this one, in any order of columns.

    Rows are sorted into ranges of even size, whatever the order's values, and written once; sums run within a range and
    the sums of the ranges before, a row a range and ``by``, are added. Nulls come first, ``order`` should tell rows apart.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    path = f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    written = spark.read.schema(df.withColumn("_range", F.lit(0)).schema).parquet(path)
    own = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = written.withColumns({f"_in_{n}": F.sum(v).over(own) for n, v in sums.items()})
    totals = written.groupBy("_range", *by).agg(*[F.sum(v).alias(f"_all_{n}") for n, v in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = totals.select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    same = F.col("_range") == F.col("_at")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return inner.join(bases, same).select(*df.columns, *[(F.col(f"_base_{n}") + F.coalesce(f"_in_{n}", F.lit(0))).alias(n) for n in sums])


def ranked(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Adds each row's place (from 1) among the rows of the same ``by`` in the order of a whole number."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), by, order, "_one", name).drop("_one")


def in_blocks(df: DataFrame, by: list[str], rank: str, before: int, width: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """Rows dealt to blocks of ranks, each with the last ``before`` rows of the block before (``_own`` is false there).

    Gives the rows and the columns of a block, for windows that reach back so far; no task holds a whole series.
    """
    width = max(width, before)
    block, place = F.expr(f"{rank} div {width}"), F.col(rank) % width
    guest = F.when(place >= width - before, F.struct((block + 1).alias("b"), F.lit(False).alias("own")))
    dealt = df.withColumn("_at", F.explode(F.array_compact(F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), guest))))
    return dealt.withColumn("_block", F.col("_at.b")).withColumn("_own", F.col("_at.own")).drop("_at"), [*by, "_block"]


def read_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as far as the planner knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def bucket_digits(size: int) -> int:
    """Hex digits of a hash that make buckets of about ``BUCKET`` bytes, of so much input; seven at most."""
    return next(d for d in range(DIGITS, 8) if size <= BUCKET * 16**d or d == 7)


def global_position(df: DataFrame, key: str, tie: str, name: str = "position", by: list[str] | None = None) -> DataFrame:
    """Adds each row's place (from 0) in the order of a hash key (of each ``by``): counts of buckets before it, and its rank in its own."""
    by = by or []
    digits = bucket_digits(read_bytes(df))
    cut = df.withColumn("_bucket", F.left(F.col(key), F.lit(digits)))
    sizes = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    if digits > DIGITS:  # too many buckets for one window
        numbered = running_sum(sizes.withColumns({"_all": F.lit(0), "_n": F.conv("_bucket", 16, 10).cast("long")}), by or ["_all"], "_n", "_size", "_upto")
        bases = numbered.select(*by, "_bucket", (F.col("_upto") - F.col("_size")).alias("_base"))
    else:
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** DIGITS rows each
        bases = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(key, tie)) - 1
    bases = bases if by or digits > DIGITS else F.broadcast(bases)
    return cut.withColumn("_rank", rank).join(bases, [*by, "_bucket"]).withColumn(name, F.col("_base") + F.col("_rank")).drop("_bucket", "_base", "_rank")
