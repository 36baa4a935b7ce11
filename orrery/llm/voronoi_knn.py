"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots, a bounded number of the vectors themselves, cut space into cells. Data and queries go to the cell of their nearest pivot. Each data
cell is summed up: its size, its radius and the distances of its members nearest to the pivot. Each query gets a floor under its k-th
best score, from its scores with the pivots and from q.p - |q| d for the members that the summaries list. Queries are grouped by cell
to blocks of some hundred; a block has a centre c, a radius u, and the least floor f of its queries.

A vector x can only be among the best of some query of a block if c.x + u |x| >= f, as q.x = c.x + (q - c).x. The same bound for a whole
cell, c.p + |c| r + u (|p| + r) >= f, spares looking at its members. Only vectors that pass are replicated to the block, in slices of
bounded size, and each (block, slice) is solved by one matrix product. Partial results of k rows a query are merged by rank.

So neither a cell that holds a third of all vectors nor a block's whole share of data ever sits in one task.

Components become floor(256 * x) as integers, and scores are exact: products run in 64-bit floats where all sums stay below 2 ** 53, else
in 64-bit integers. Ties go to the smaller id.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither do null ids; vectors of unlike lengths are
padded with zeros, so an empty one scores 0 with all; a component whose integer leaves 64 bits becomes the nearest that doesn't, and a score that does is an error; rows that repeat an id each count as a
candidate, a query's own id is never one, and a query that repeats its vector too asks once; other columns are ignored; an
empty table, or one without partners, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut, need, small_batches, spread

K, SCALE, EVERY = 5, 256, 50
#: Pivots, queries in a block and vectors in a slice, at most or nearly so.
PIVOTS, BLOCK, SLICE = 64, 512, 8192
ROUNDING = 1e-9


def integers(data: DataFrame, id_: str, vec: str, scale: int) -> DataFrame:
    """(id, vec): the vectors that take part, as integers."""
    scaled = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return data.where(F.col(id_).isNotNull() & F.col(vec).isNotNull()).where(fine).select(F.col(id_).cast("long").alias("id"), scaled.alias("vec"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` integers, padded with zeros."""
    lists = column.cast(pa.list_(pa.int64()))
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)] = flat
    return out


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All inner products, exactly: as 64-bit integers, or as Python's where those may not suffice."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(float) @ data.astype(float).T).astype(np.int64)
    if most < 2**63:
        return queries @ data.T
    return queries.astype(object) @ data.T.astype(object)


def in_64_bits(row: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; an error if they can't be."""
    if row.dtype == object and max(map(abs, row), default=0) >= 2**63:
        raise OverflowError("scores of these vectors don't fit 64 bits")
    return row.astype(np.int64)


def best(ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -found))[:k]


def nearest(cell: np.ndarray, distance: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of each cell's n nearest ids, of each id its nearest row."""
    order = np.lexsort((distance, ids, cell))
    own = order[np.r_[True, (np.diff(cell[order]) != 0) | (np.diff(ids[order]) != 0)]] if len(order) else order
    own = own[np.lexsort((ids[own], distance[own], cell[own]))]
    return own[np.arange(len(own)) - np.searchsorted(cell[own], cell[own]) < n]


class Pivots:
    """The pivots, with what the summaries of their cells say."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.exact = ids, vectors.astype(float), vectors
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.radius = np.zeros(len(ids))
        self.near: list[list[tuple[float, int]]] = [[] for _ in ids]

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.vectors.T + (self.norms**2)[None, :], 0))


def search(data: DataFrame, id_: str = "vec_id", vec: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by `every`, among all other rows."""
    need(data, id_, vec)
    spark = data.sparkSession
    vectors = integers(data, id_, vec, scale)
    facts = vectors.agg(F.count("*"), F.coalesce(F.greatest(F.max(F.size("vec")), F.lit(1)), F.lit(1)), F.coalesce(F.sum((F.col("id") % every == 0).cast("long")), F.lit(0))).first()
    total, width, n_queries = int(facts[0]), int(facts[1]), int(facts[2])
    schema = "query_id long, rank int, vec_id long, score long"
    if not total or not n_queries:
        return spark.createDataFrame([], schema)
    chosen = vectors.dropDuplicates(["vec"]).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # `pivots` rows
    padded = np.zeros((len(chosen), width), np.int64)
    for r, row in enumerate(chosen):
        padded[r, : len(row["vec"])] = row["vec"]
    cells = Pivots(np.array([r["id"] for r in chosen], np.int64), padded)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            distance = cells.distances(matrix(b.column("vec"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(distance.argmin(1).astype(np.int32)), pa.array(distance.min(1) if len(distance) else np.zeros(0))], names=["id", "vec", "cell", "distance"])

    placed = cut(spread(vectors).mapInArrow(to_cells, "id long, vec array<long>, cell int, distance double"))

    # Summaries: one row for each cell, and the k + 1 ids nearest to the pivot, each with its nearest row, so that k are left whichever id asks.
    for r in placed.groupBy("cell").agg(F.max("distance").alias("radius")).collect():
        cells.radius[r["cell"]] = r["radius"]
    def to_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, distance, ids = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)
        for b in small_batches(batches, 4096):
            cell, distance, ids = (np.r_[x, b.column(n).to_numpy()] for x, n in ((cell, "cell"), (distance, "distance"), (ids, "id")))
            kept = nearest(cell, distance, ids, k + 1)
            cell, distance, ids = cell[kept], distance[kept], ids[kept]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(distance), pa.array(ids)], names=["cell", "distance", "id"])

    per_task = placed.select("cell", "distance", "id").mapInArrow(to_nearest, "cell int, distance double, id long")
    by_distance = Window.partitionBy("cell").orderBy("distance", "id")
    members = per_task.groupBy("cell", "id").agg(F.min("distance").alias("distance")).withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= k + 1)
    for r in members.orderBy("cell", "n").collect():
        cells.near[r["cell"]].append((r["distance"], r["id"]))
    known = spark.sparkContext.broadcast(cells)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = known.value
        near = np.array([x for n in c.near for x, _ in n])
        near_ids = np.array([i for n in c.near for _, i in n], np.int64)
        near_cell = np.repeat(np.arange(len(c.near)), [len(n) for n in c.near])
        for b in small_batches(batches, 1024):
            q = matrix(b.column("vec"), width)
            ids = b.column("id").to_numpy()
            norm = np.linalg.norm(q.astype(float), axis=1)
            with_pivots = scores(q, c.exact).astype(float)
            listed = with_pivots[:, near_cell] - norm[:, None] * near[None]
            listed[ids[:, None] == near_ids[None, :]] = -np.inf
            with_pivots[ids[:, None] == c.ids[None, :]] = -np.inf
            listed = np.partition(listed, -k, 1)[:, -k] if listed.shape[1] >= k else np.full(len(q), -np.inf)
            scored = np.partition(with_pivots, -k, 1)[:, -k] if len(c.ids) >= k else np.full(len(q), -np.inf)
            floor = np.maximum(listed, scored)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm), pa.array(np.where(np.isnan(floor), -np.inf, floor))], names=[*b.schema.names, "norm", "floor"])

    queries = placed.where(F.col("id") % every == 0).dropDuplicates(["id", "vec"])
    # Blocks: a cell's queries, cells in the order of their pivots' numbers, until a block is full; crowded cells are dealt by hash.
    counts = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    centre_of, first_block, parts, room = [], {}, {}, 0
    for cell in sorted(counts):
        parts[cell] = -(-counts[cell] // block)
        if parts[cell] == 1 and counts[cell] <= room:
            first_block[cell] = len(centre_of) - 1
            room -= counts[cell]
        else:
            first_block[cell] = len(centre_of)
            centre_of += [cell] * parts[cell]
            room = block - counts[cell] if parts[cell] == 1 else 0
    deal = spark.createDataFrame([(c, first_block[c], parts[c]) for c in counts], "cell int, first int, parts int")
    dealt = queries.join(F.broadcast(deal), "cell").select("id", "vec", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
    asked = cut(dealt.mapInArrow(floors, "id long, vec array<long>, block int, norm double, floor double"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            centre = known.value.vectors[np.array(centre_of)[b.column("block").to_numpy()]]
            away = np.linalg.norm(matrix(b.column("vec"), width) - centre, axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("floor"), pa.array(away)], names=["block", "floor", "away"])

    # A row for each block of some hundred queries: three numbers.
    blocks = asked.mapInArrow(spans, "block int, floor double, away double").groupBy("block").agg(F.min("floor").alias("floor"), F.max("away").alias("away")).collect()
    number = np.array([r["block"] for r in blocks], np.int64)
    floor, away = np.array([r["floor"] for r in blocks]), np.array([r["away"] for r in blocks])
    centre = cells.vectors[np.array(centre_of)[number]]
    cell_most = centre @ cells.vectors.T + np.linalg.norm(centre, axis=1)[:, None] * cells.radius + away[:, None] * (cells.norms + cells.radius)
    slack = ROUNDING * (1 + np.abs(cell_most)) + 1e-6
    pivots_used, of_pivot = np.unique(np.array(centre_of)[number], return_inverse=True)
    plan = spark.sparkContext.broadcast((number, floor, away, of_pivot, cells.vectors[pivots_used], (cell_most + slack >= floor[:, None])))

    def admitted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The blocks that need rows of a batch, and those rows. Blocks share the pivots as centres: products are made once for each pivot, and blocks are looked at only for rows that the widest and least demanding block of a pivot admits."""
        number, floor, away, of_pivot, centres, cell_passes = plan.value
        x = matrix(b.column("vec"), width).astype(float)
        length, cell = np.linalg.norm(x, axis=1), b.column("cell").to_numpy()
        product = centres @ x.T
        blocks, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in range(len(centres)):
            own = np.flatnonzero(of_pivot == c)
            bound = lambda u, f: product[c] + u * length + ROUNDING * (np.abs(product[c]) + u * length) + 1e-6 >= f  # noqa: B023, E731
            some = np.flatnonzero(bound(away[own].max(), floor[own].min()))
            for first in range(0, len(own) if len(some) else 0, 256):
                part = own[first : first + 256]
                most = product[c][None, some] + away[part][:, None] * length[None, some]
                passes = (most + ROUNDING * np.abs(most) + 1e-6 >= floor[part][:, None]) & cell_passes[part][:, cell[some]]
                i, j = np.nonzero(passes)
                blocks.append(number[part[i]])
                rows.append(some[j])
        return np.concatenate(blocks), np.concatenate(rows)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for b in small_batches(batches, 2048):
            for block_, n in zip(*(a.tolist() for a in np.unique(admitted(b)[0], return_counts=True)), strict=True):
                counts[block_] = counts.get(block_, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["block", "n"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2048):
            of_block, row = admitted(b)
            yield pa.RecordBatch.from_arrays([pa.array(of_block.astype(np.int32)), b.column("id").take(pa.array(row)), b.column("vec").take(pa.array(row))], names=["block", "id", "vec"])

    # How many rows a block gets decides into how many slices they fall, and to how many its queries are copied. A row for each block.
    work = placed.select("id", "vec", "cell")
    load = F.broadcast(cut(work.mapInArrow(tally, "block int, n long").groupBy("block").agg(F.ceil(F.sum("n") / slice_).cast("int").alias("slices"))))
    needed = work.mapInArrow(replicate, "block int, id long, vec array<long>").join(load, "block")
    data_rows = needed.select("block", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("asks"), "id", "vec")
    query_rows = asked.join(load, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("asks"), "id", "vec")

    def solve(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        whole = matrix(group.column("vec").combine_chunks(), width)
        ids = group.column("id").to_numpy()
        q, x, q_ids, x_ids = whole[asks], whole[~asks], ids[asks], ids[~asks]
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(x):
            found = scores(q, x)
            for r, own in enumerate(q_ids):
                others = np.flatnonzero(x_ids != own)
                row = in_64_bits(found[r, others])
                if len(others) > 8 * k:  # all at or above the k-th score, with its ties
                    kept = row >= np.partition(row, -k)[-k]
                    others, row = others[kept], row[kept]
                top = best(x_ids[others], row, k)
                out.append((np.full(len(top), own), x_ids[others[top]], row[top]))
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    partial = data_rows.union(query_rows).groupBy("block", "slice").applyInArrow(solve, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(data: DataFrame) -> DataFrame:
    """Result of op3: k rows for each query."""
    return search(data)


ORACLE = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([z[1] * z[2] for z in list_zip(q.v, d.v)]) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
