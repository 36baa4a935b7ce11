"""The approximate index against exact search."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import approximate as A
from orrery.operators import vector


def recall(found, exact):
    return found.select("query", "key").join(exact.select("query", "key"), ["query", "key"], "left_semi").count() / exact.count()


@pytest.mark.parametrize("slice_", [A.SLICE, 7])
def test_recall(spark, data, monkeypatch, slice_):
    monkeypatch.setattr(A, "SLICE", slice_)
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("vec"))
    asked = rows.withColumnRenamed("key", "query")
    index = A.tuned(A.build(rows, cells=16, probes=1), asked, 5)
    exact = vector.search(rows, asked, 5)
    assert index.cells.count() == rows.count() and index.recall >= 0.9 and recall(A.find(index, asked, 5), exact) >= 0.9
    whole = A.find(index, asked, 5, probes=16)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_edges(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "key string, vec array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("n", None)], "query string, vec array<double>")
    index = A.build(rows)
    assert [(r["query"], r["key"], r["score"]) for r in A.find(index, asked, 1).collect()] == [("q", "a", 1.0)]
    assert A.find(A.build(rows.limit(0)), asked, 3).count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        A.find(index, spark.createDataFrame([("q", [1.0])], "query string, vec array<double>"), 1).collect()
