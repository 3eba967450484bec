"""A training corpus from ``documents``: toxic texts go, one of each group of near duplicates stays, texts that hold
benchmark passages go, and what is left is encoded.

Every stage works on all rows that the one before kept. ``run`` writes each stage's rows as Parquet to the folder that
driver and executors share and reads them again, so a lost executor costs tasks of one stage only.

Null and empty texts are not toxic and hold no benchmark passage; as near duplicates they are one group, of which one row
stays. Of repeated rows, and of ties, one stays, the one of the smallest id, null ids last. Texts are read whole, however
long. All stages but the last keep every column, whatever its name; the last gives the ids and digests of each document.
An empty table gives no rows.

Near duplicates are those whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash balls link
those whose fingerprints differ in two bits at most, which is as far as they reach; an exact prefix join links the rest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, neardup, pieces, toxicity
from millrace.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A fitted classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
