"""Helpers shared by the language-model operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import remove, shared_dir

#: Bits of a vector's components as whole numbers.
WIDEST = 25
#: A-Z to a-z and nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table that this application wrote; what was computed from them can't be read after that."""
    remove(spark, shared_dir(spark))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Jobs in it send so many rows at a time to Python, as texts are long and executors small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str, compression: str = "snappy", batch: int = 2000, written: list[str] | None = None) -> DataFrame:
    """Write a DataFrame once to the shared folder and return the written table, its path put on the list ``written``.

    Later jobs read it, so work in Python runs once and lost executors cost a rerun of single tasks only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if written is not None:
        written.append(path)
    with small_batches(spark, batch):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a DataFrame once to the shared folder in as many buckets by ``key`` as a shuffle has, so grouping by it moves no row."""
    return dropped_later(df, name, key)[0]


def dropped_later(df: DataFrame, name: str, key: str, batch: int = 2000) -> tuple[DataFrame, Callable[[], None]]:
    """``bucketed``, and what drops the table and its files when nothing reads it any more."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own bound
    with small_batches(spark, batch):
        df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)

    return spark.table(name), drop


def whole_numbers(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding", size: int | None = None) -> DataFrame:
    """Rows (vec_id, q): components as floor(scale * x), x as double, of vectors that are whole; of ``size`` components, if given.

    Vectors that are null or hold null or non-finite components are left out. A number of ``WIDEST`` bits or more is an
    error, as products and their sums are 64-bit numbers.
    """
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where("x is not null")
    kept = x.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    if size is not None:
        kept = kept.where(F.size("x") == size)

    def number(v):
        return F.when(F.abs(v * scale) < float(1 << WIDEST), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    return kept.select("vec_id", F.transform("x", number).alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of number lists as a matrix of int64, short rows filled with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def utf8(column) -> list[bytes | None]:
    """A string column of a batch as UTF-8 bytes, nulls kept."""
    return column.cast(pa.large_binary()).to_pylist()


#: What a worker remembers from task to task, each with a method ``forget``.
REMEMBERING: list = []


def release(own=None) -> None:
    """Give memory back to the system, as Spark keeps idle Python workers for later stages; what others than ``own`` remember goes, too."""
    for held in REMEMBERING:
        if held is not own:
            held.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def shared_files(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a path in the shared folder, for tasks that read single files of their own."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def as_int64(unsigned: np.ndarray) -> np.ndarray:
    return np.asarray(unsigned, dtype=np.uint64).view(np.int64)


def slices(batch: pa.RecordBatch, texts: str, limit: int = 8 << 20):
    """Cut a batch into pieces of about ``limit`` text bytes; one long text makes one piece."""
    sizes = np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column(texts)).to_pylist()), np.int64, batch.num_rows)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
