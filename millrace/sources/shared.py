"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder takes its place in local mode only, and it is an error to lack one elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif spark.sparkContext.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    system, path = _path(spark, name)
    return system.exists(path)


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small file, written beside its name and moved there when whole."""
    system, path = _path(spark, name)
    _, own = _path(spark, f"{name}.{uuid.uuid4().hex}")
    out = system.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(path, False)
    system.rename(own, path)


def read_text(spark: SparkSession, name: str) -> str:
    return spark.read.text(name, wholetext=True).first()[0]
