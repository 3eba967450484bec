"""Queries of the operators in this subpackage and their SQL, for ``__spark_entry__``.

Each callable takes (spark, sf_dir) and applies one operator, with the parameters meant for production, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, fim, html_text, lm, merkle, pieces, repair, simhash, topk, toxicity, urls, yinyang
from millrace.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.listing(spark, urls.LISTED))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents"))


def op9_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_lm_scores, op3_toxicity, op4_url_filter, op5_sentencepiece, op6_decontamination, op7_html_text, op8_merkle, op9_repair, op10_token_counts, op11_fill_in_middle, op12_top_k, op13_clusters)
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op4_url_filter": urls.sql(), "op6_decontamination": decontaminate.SQL, "op8_merkle": merkle.SQL, "op11_fill_in_middle": fim.SQL, "op12_top_k": topk.SQL, "op13_clusters": yinyang.sql()}
