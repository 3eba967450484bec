"""Readers: tables of a folder, document sidecars and mix manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def token_width(vocab_size: int) -> str:
    """Smallest unsigned type that holds every id of a vocabulary."""
    for bits in (8, 16, 32):
        if vocab_size - 1 <= 2**bits - 1:
            return f"u{bits // 8}"
    return "u8"


def sidecar(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Document bounds (start, end) from gzip CSV; further columns are ignored."""
    return spark.read.schema("start long, end long").option("enforceSchema", True).csv(paths)


def mix_manifest(spark: SparkSession, path: str, base: str, tokenizer: str, aliases: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Rows (place, label, path) of a manifest of ``label,path`` lines; blank lines and # comments are left out.

    A label goes by its alias if it has one. Errors name the line: one without exactly one comma, one whose label comes again
    after other labels and, if ``strict``, one whose path lacks ``{TOKENIZER}``. The manifest is read as one text.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("_n", "line")).select((F.col("_n") + 1).alias("place"), F.trim("line").alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", ",")
    label = F.trim(F.get(parts, F.lit(0)))
    if aliases:
        names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        label = F.coalesce(F.try_element_at(names, label), label)
    t = lines.select("place", "line", label.alias("label"), F.trim(F.get(parts, F.lit(1))).alias("_path"), F.size(parts).alias("_parts"))
    order = Window.orderBy("place")  # a row a line of one file
    starts = F.coalesce(F.lag("label").over(order) != F.col("label"), F.lit(True))
    t = t.withColumn("_start", starts)
    t = t.withColumn("_runs", F.count_if("_start").over(Window.partitionBy("label").orderBy("place")))
    wrong = F.when(F.col("_parts") != 2, "is no label and path").when(F.col("_runs") > 1, "has a label that came before others")
    if strict:
        wrong = wrong.when(~F.contains("_path", F.lit("{TOKENIZER}")), "names no {TOKENIZER}")
    message = F.concat(F.lit("line "), F.col("place").cast("string"), F.lit(" of the manifest "), wrong)
    place = F.concat(F.lit(base.rstrip("/") + "/"), F.replace("_path", F.lit("{TOKENIZER}"), F.lit(tokenizer)))
    return t.select("place", "label", F.when(wrong.isNull(), place).otherwise(F.raise_error(message)).alias("path"))
