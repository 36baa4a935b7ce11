"""A pipeline over documents: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe_automaton, decontamination, jaccard_join, language_id, recompression
from orrery.llm.common import spread, table, use_checkpoint_dir
from orrery.llm.queries import tokenizer_path

#: Near duplicates: five words to a shingle, 80 percent of all shingles in common.
WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters, or of no known language, go."""
    return language_id.known(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id."""
    return jaccard_join.one_of_each(docs, WORDS, PERCENT)


def packed(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text in one, rest, so that no name clashes with what an operator adds."""
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("rest"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less words in passages of 50 words or more that a document with a smaller doc_id has too."""
    found = recompression.dedup(packed(docs))
    gone = F.col("n_removed") > 0
    changed = {"doc_id": F.col("doc_id"), "text": F.when(gone, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(gone, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return found.select(*(changed.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, the number of them, and digests of the ids and of the text they decode to. A column of documents that has one of these names gives way."""
    encoded = bpe_automaton.encode_decode(packed(spread(docs)), tokenizer_path())
    made = {"token_ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    own = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in made]
    return encoded.select(*own, "token_ids", *bpe_automaton.digests(encoded))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", one_of_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: Language models, components and automata have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage but the last is written to the shared checkpoint folder and read again; what came before it is deleted then."""
    use_checkpoint_dir(spark)
    work = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{work}/{k}")
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
