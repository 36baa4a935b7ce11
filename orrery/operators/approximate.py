"""Approximate vector search: an inverted index of cells around centres.

The centres are fitted on a bounded sample (SAMPLE vectors, by a hash of the key); every vector is indexed, in the cell of its nearest centre. A query looks at the cells of its `probes` nearest
centres. How many that must be for a recall is measured: a bounded number of queries is answered exactly and with more and more probes until the recall is reached, at worst with all cells, which is
exact. A cell of more than SLICE vectors falls to slices by hash, so that no task holds a cell that most vectors are in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.vector import search
from orrery.session import settled

#: Vectors that centres are fitted on, rounds of fitting, vectors in a slice of a cell, and queries that recall is measured with, at most.
SAMPLE, ROUNDS, SLICE, MEASURED = 20_000, 12, 8192, 200


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    if (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError("dimension mismatch")
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))


@dataclass
class Index:
    """cells: (key, vec, cell, slice) of every vector; centres: a row each, of unit length; slices: how many slices each cell has; probes: cells that a query looks at."""

    cells: DataFrame
    centres: np.ndarray
    slices: dict[int, int]
    probes: int
    recall: float | None = None


def build(vectors: DataFrame, cells: int = 64, probes: int = 8) -> Index:
    """An index of vectors (key, vec); null vectors take no part."""
    spark = vectors.sparkSession
    known = vectors.where("vec IS NOT NULL").select("key", F.col("vec").cast("array<double>").alias("vec"))
    drawn = known.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()  # SAMPLE rows
    if not drawn:
        return Index(settled(known.select("key", "vec", F.lit(0).alias("cell"), F.lit(0).alias("slice"))), np.zeros((0, 0)), {}, probes)
    if len({len(r["vec"]) for r in drawn}) > 1:
        raise ValueError("dimension mismatch")
    x = _unit(np.array([r["vec"] for r in drawn], float))
    dim = x.shape[1]
    centres = np.unique(x[: min(cells, len(x))], axis=0)
    for _ in range(ROUNDS):  # spherical k-means; a centre without vectors stays
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.abs(sums).sum(1, keepdims=True) > 0, _unit(sums), centres)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_rows(b.column("vec"), dim) @ shared.value.T).argmax(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vec"), pa.array(near.astype(np.int32))], names=["key", "vec", "cell"])

    kind = dict(vectors.dtypes)["key"]
    placed = settled(known.mapInArrow(assign, f"key {kind}, vec array<double>, cell int"))
    slices = {r["cell"]: -(-r["n"] // SLICE) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    counts = F.create_map(*(F.lit(v) for kv in slices.items() for v in kv)) if slices else F.create_map().cast("map<int,int>")
    return Index(placed.withColumn("slice", F.pmod(F.xxhash64("key"), F.element_at(counts, F.col("cell"))).cast("int")), centres, slices, min(probes, len(centres)))


def find(index: Index, queries: DataFrame, k: int, probes: int | None = None, digits: int = 4) -> DataFrame:
    """(query, key, score, rank): of the vectors in the nearest cells the k nearest by cosine, rounded, ties to the lower key. queries: (query, vec)."""
    kinds = dict(queries.dtypes) | {"key": dict(index.cells.dtypes)["key"]}
    schema = f"query {kinds['query']}, key {kinds['key']}, score double"
    spark = queries.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], schema + ", rank int")
    probes, dim = min(probes or index.probes, len(index.centres)), index.centres.shape[1]
    shared = spark.sparkContext.broadcast((index.centres, index.slices))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, slices = shared.value
        for b in batches:
            near = np.argsort(-(_rows(b.column("vec"), dim) @ centres.T), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, probes), int)
            to = [(r, c, s) for r, row in enumerate(near.tolist()) for c in row for s in range(slices.get(c, 0))]
            row, cell, piece = (np.array(x, np.int64) for x in zip(*to, strict=True)) if to else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(row)), b.column("vec").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(piece.astype(np.int32))], names=["query", "vec", "cell", "slice"])

    asked = queries.where("vec IS NOT NULL").select("query", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(route, f"query {kinds['query']}, vec array<double>, cell int, slice int")

    def solve(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            names, keys_ = left.column("query").to_pylist(), np.array(right.column("key").to_pylist(), object)
            matrix = _rows(right.column("vec").combine_chunks(), dim).T
            asks = _rows(left.column("vec").combine_chunks(), dim)
            for first in range(0, len(names), 1024):
                scores = np.round(asks[first : first + 1024] @ matrix, digits) + 0.0
                for name, row in zip(names[first : first + 1024], scores, strict=True):
                    at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    out += [(name, key, float(s)) for s, key in sorted(((row[i], keys_[i]) for i in at), key=lambda x: (-x[0], x[1]))[:k]]
        fields = pa.schema([("query", left.schema.field("query").type), ("key", right.schema.field("key").type), ("score", pa.float64())])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ((), (), ()), fields, strict=True)], schema=fields)

    partial = asked.groupBy("cell", "slice").cogroup(index.cells.groupBy("cell", "slice")).applyInArrow(solve, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tuned(index: Index, queries: DataFrame, k: int, recall: float = 0.9) -> Index:
    """The index with as many probes as reach a recall on at most MEASURED of the queries, against exact search of the same."""
    some = settled(queries.orderBy(F.xxhash64("query"), "query").limit(MEASURED))
    exact = settled(search(index.cells.select("key", "vec"), some, k).select("query", "key"))
    of, probes = exact.count(), index.probes
    while True:
        found = find(index, some, k, probes).select("query", "key").join(exact, ["query", "key"], "left_semi").count()
        got = found / of if of else 1.0
        if got >= recall or probes >= len(index.centres):
            return Index(index.cells, index.centres, index.slices, probes, got)
        probes = min(2 * probes, len(index.centres))
