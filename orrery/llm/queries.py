"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe_automaton, chat_format, decontamination, jaccard_join, language_id, license_scan, mincut_extract, recompression, toxicity, voronoi_knn
from orrery.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.query(table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.query(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.query(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents"))


def op8_mincut_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut_extract.query(table(spark, sf_dir, "pages"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.query(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_voronoi_knn, op4_chat_format, op5_toxicity, op6_bpe_automaton, op7_language_id, op8_mincut_extract, op9_recompression, op10_jaccard_join)}

ORACLES: dict[str, str] = {"op2_decontamination": decontamination.ORACLE, "op3_voronoi_knn": voronoi_knn.ORACLE, "op4_chat_format": chat_format.ORACLE, "op9_recompression": recompression.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE}
