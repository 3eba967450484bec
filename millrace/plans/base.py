"""The registry of queries, and what their plans and their SQL have in common.

``documents`` stand for token shards (source: file, doc_id: order), ``labels`` for masks, ``events`` for metric streams,
``embeddings`` for logits and router scores. Arrays are reported by sums weighted with places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import documents
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def checksum(ids: Column) -> Column:
    """Sum of place (from 1) times value."""
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("s"))
    return F.aggregate(ids, start, lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["s"] + (a["i"] + 1) * x).alias("s")), lambda a: a["s"])


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.tokenized(table(spark, sf, "documents"))


def sized(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with their lengths, without tokens."""
    return documents.lengths_of(table(spark, sf, "documents")).drop("text")


_SPACE = documents.SPACE
TOK = f"""WITH tok AS (SELECT doc_id, source, lang, t, length(t) + 1 AS n FROM (SELECT doc_id, source, lang, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t FROM documents) WHERE t <> ''),
placed AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM tok),
docs AS (SELECT doc_id, source, lang, n, "end" - n AS "start", "end", list_append(list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT), 0::BIGINT) AS ids FROM placed)"""
SUM = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: i * {0}[i]))::BIGINT"
