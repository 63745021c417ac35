"""The queries of this subpackage: thin functions of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flightgrid.llm import chat_format, fm_decontam, golay_simhash, induced_dedup, ngram_lm, pu_toxicity, sentencepiece_bpe, template_lines, vp_search, warc
from flightgrid.llm._store import table


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.digests(table(spark, sf_dir, "documents"))


def op2_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_control_case(table(spark, sf_dir, "conversations")))


def op4_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.digests(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op7_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_lines.digests(table(spark, sf_dir, "documents"), template_lines.PASSAGE)


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.digests(table(spark, sf_dir, "documents"))


def op9_induced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induced_dedup.digests(table(spark, sf_dir, "documents"))


def op10_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_lm, op2_pu_toxicity, op3_chat_format, op4_vp_search, op5_sentencepiece, op6_warc, op7_template_lines, op8_golay_simhash, op9_induced_dedup, op10_fm_decontam)
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op4_vp_search": vp_search.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
}
