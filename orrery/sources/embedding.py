"""Texts to vectors, by an embedder that callers plug in, or by hashing words where no model is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import normalize


def hashed(text: Column, dim: int = 64) -> Column:
    """A unit vector of `dim` counts: each lower-case word counts in the slot of its hash. Null and blank texts give zeros."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double")))


def embed(rows: DataFrame, text: str = "text", vec: str = "vec", embedder: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64) -> DataFrame:
    """rows with a vector for each text. embedder gets lists of texts and gives as many vectors; it runs on Arrow batches on the executors."""
    if embedder is None:
        return rows.withColumn(vec, hashed(F.col(text), dim))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(embedder(batch.fillna("").tolist()))

    return rows.withColumn(vec, run(F.col(text)))
