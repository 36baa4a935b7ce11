"""Vector operators: exact cosine search, search followed by graph expansion, the response cache, and ranked memories.

Queries are cut to blocks of BLOCK_BYTES, each of which is sent to all executors and costs one scan of the data. Each batch of data is multiplied with MAX_QUERIES of them at a time and keeps the best k of
its rows for each query, so that only k rows a query and batch are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import composite, cosine, frequency, normalize, recency
from orrery.operators.graph import directed, traverse
from orrery.session import settled

#: Queries in one matrix product, and bytes of queries that are sent along at once.
MAX_QUERIES, BLOCK_BYTES = 1024, 64 << 20


def set_vectors(vectors: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """vectors(key, field, vec) after writes to existing nodes, stored as unit vectors; a vector whose length differs from its field's raises an error when read."""
    # The first writes of a field must agree with each other: the least key's length counts.
    first = new.join(nodes.select("key"), "key", "left_semi").groupBy("field").agg(F.min_by(F.size("vec"), "key").alias("new_dim"))
    size = vectors.groupBy("field").agg(F.max(F.size("vec")).alias("dim")).join(first, "field", "full").select("field", F.coalesce("dim", "new_dim").alias("dim"))
    known = new.join(nodes.select("key"), "key", "left_semi").join(size, "field", "left")
    checked = F.when(F.col("dim").isNull() | (F.size("vec") == F.col("dim")), normalize(F.col("vec"))).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("array<double>"))
    fresh = known.select("key", "field", checked.alias("vec"))
    return vectors.join(fresh.select("key", "field"), ["key", "field"], "left_anti").select("key", "field", F.col("vec").cast("array<double>").alias("vec")).unionByName(fresh)


def delete_vectors(vectors: DataFrame, keys: DataFrame, field: str | None = None) -> DataFrame:
    """vectors without those of the given keys, or only without one field of them."""
    gone = keys.select("key").distinct()
    if field is None:
        return vectors.join(gone, "key", "left_anti")
    return vectors.join(gone.withColumn("field", F.lit(field)), ["key", "field"], "left_anti")


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles; other lengths than dim raise an error."""
    size = np.diff(column.offsets.to_numpy())
    if (size != dim).any():
        raise ValueError("dimension mismatch")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """(query, key, score, rank): the k nearest by cosine, rounded, ties to the lower key. queries: (query, vec); vectors: (key, vec). Null vectors take no part.

    A block of queries is a matrix of bounded size on every executor; each batch of vectors is one matrix product for MAX_QUERIES of them, of which k rows a query go on.
    """
    kinds = dict(queries.dtypes) | {"key": dict(vectors.dtypes)["key"]}
    schema = f"query {kinds['query']}, key {kinds['key']}, score double"
    asking = queries.where("vec IS NOT NULL").select("query", F.col("vec").cast("array<double>").alias("vec"))
    count, least, most = asking.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if not count:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    if least != most:
        raise ValueError("dimension mismatch")
    n = -(-count // max(1, BLOCK_BYTES // (8 * max(1, most))))
    partial = []
    for part in range(n):
        block = asking if n == 1 else asking.where(F.pmod(F.xxhash64("query"), F.lit(n)) == part)
        asked = block.collect()  # about BLOCK_BYTES
        if not asked:
            continue
        shared = queries.sparkSession.sparkContext.broadcast(([r["query"] for r in asked], _unit(np.array([r["vec"] for r in asked], float).reshape(len(asked), most))))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                keys, rows = np.array(b.column("key").to_pylist(), object), _unit(_rows(b.column("vec"), matrix.shape[1])).T
                for first in range(0, len(names), MAX_QUERIES):
                    scores = np.round(matrix[first : first + MAX_QUERIES] @ rows, digits) + 0.0
                    found: list[tuple] = []
                    for name, row in zip(names[first : first + MAX_QUERIES], scores, strict=True):
                        at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                        found += [(name, key, float(s)) for s, key in sorted(((row[i], keys[i]) for i in at), key=lambda x: (-x[0], x[1]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["query", "key", "score"])

        partial.append(vectors.where("vec IS NOT NULL").select("key", "vec").mapInArrow(best, schema))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return reduce(DataFrame.unionByName, partial).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def rag(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, depth: int = 1, direction: str = "OUT", edge_type: str | None = None, node_type: str | None = None) -> DataFrame:
    """(query, key, score, neighbors): the k nearest, each with the sorted keys that an expansion from it reaches, itself left out."""
    hits = search(vectors, queries, k).select("query", "key", "score")
    around = traverse(nodes, edges, hits.select("key").distinct(), depth, direction, [edge_type] if edge_type else None, node_type).where("depth > 0").groupBy(F.col("seed").alias("key")).agg(F.sort_array(F.collect_set("key")).alias("neighbors"))
    return hits.join(around, "key", "left").select("query", "key", "score", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))


# -- response cache: (key, response, threshold, tag, expires_at_ms, vec) --------------------------------------------------------


def cache_set(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache after writes (with seq): the last write of a key replaces its entry."""
    last = new.groupBy("key").agg(F.max_by(F.struct(*(c for c in cache.columns if c != "key")), "seq").alias("r")).select("key", "r.*")
    return cache.join(last.select("key"), "key", "left_anti").unionByName(last.select(*cache.columns))


def cache_get(cache: DataFrame, queries: DataFrame, now_ms: int, threshold: float | None = None, count: int = 1) -> DataFrame:
    """(query, key, response, score) for each query with a hit among its `count` nearest entries: the nearest that isn't expired and reaches the threshold.
    Cache entries are expired from their time on."""
    near = search(cache, queries, count).join(cache.select("key", "response", "threshold", "expires_at_ms"), "key")
    limit = F.col("threshold") if threshold is None else F.lit(threshold)
    fine = near.where((F.col("expires_at_ms").isNull() | (F.lit(now_ms) < F.col("expires_at_ms"))) & (F.col("score") >= limit))
    return fine.groupBy("query").agg(F.min_by(F.struct("key", "response", "score"), "rank").alias("r")).select("query", "r.*")


def cache_invalidate(cache: DataFrame, key: str | None = None, tag: str | None = None) -> DataFrame:
    """cache without one key, or without a tag's entries."""
    gone = F.col("key") == key if key is not None else F.coalesce(F.col("tag") == tag, F.lit(False))
    return cache.where(~gone)


def cache_stats(cache: DataFrame, queries: DataFrame, now_ms: int, threshold: float | None = None, count: int = 1) -> DataFrame:
    """(hits, misses, entries) of a batch of queries."""
    hits = cache_get(cache, queries, now_ms, threshold, count).select("query", F.lit(1).alias("hit"))
    counted = queries.select("query").join(hits, "query", "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return counted.join(cache.agg(F.count("*").alias("entries")))


# -- memories: (agent, id, text, type, importance, created_at, access_count, halflife, vec, ...) -----------------------------------


def named_memories(memories: DataFrame, new: DataFrame) -> DataFrame:
    """new, with a missing id as mem:<agent>:<n>, on from the largest n that the agent has."""
    number = F.regexp_extract("id", r"^mem:.*:([0-9]{1,18})$", 1)
    used = memories.where(F.startswith(F.col("id"), F.concat(F.lit("mem:"), F.col("agent"), F.lit(":"))) & (number != "")).groupBy("agent").agg(F.max(number.cast("long")).alias("used"))
    counter = F.row_number().over(Window.partitionBy("agent", F.col("id").isNull()).orderBy("seq"))
    count = F.when(F.col("id").isNull(), counter)
    named = new.withColumn("count", count).join(used, "agent", "left")
    own = F.concat(F.lit("mem:"), "agent", F.lit(":"), (F.col("count") + F.coalesce("used", F.lit(0))).cast("string"))
    return named.withColumn("id", F.coalesce("id", own)).select(*new.columns)


def memory_store(memories: DataFrame, new: DataFrame) -> DataFrame:
    """memories after stores (with seq; id may be null): a missing id becomes mem:<agent>:<n>, counting on from the agent's largest; an id that exists is overwritten."""
    rest = [c for c in memories.columns if c not in ("agent", "id")]
    last = named_memories(memories, new).groupBy("agent", "id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("agent", "id", "r.*")
    return memories.join(last.select("agent", "id"), ["agent", "id"], "left_anti").unionByName(last.select(*memories.columns))


def retention(now: int):
    """recency * importance * frequency."""
    return composite(F.lit(1.0), recency(F.col("created_at"), F.col("halflife"), now), F.col("importance"), frequency(F.col("access_count")))


def recall(memories: DataFrame, queries: DataFrame, now: int, limit: int = 10, threshold: float = 0.5, kind: str | None = None, after: int | None = None, before: int | None = None, boost: str | None = None, tag: str | None = None) -> DataFrame:
    """(query, agent, id, score, similarity, rank): each query's (query, agent, vec) best memories of its own agent. Filters come before ranking, so no agent starves another."""
    own = memories if tag is None else memories.where(F.col("tag") == tag)
    if kind is not None:
        own = own.where(F.col("type") == kind)
    if after is not None:
        own = own.where(F.col("created_at") >= after)
    if before is not None:
        own = own.where(F.col("created_at") <= before)
    asked = queries.select("query", "agent", F.col("vec").alias("q"))
    similarity = F.round(cosine(F.col("vec"), F.col("q")), 4)
    scored = own.join(asked, "agent").withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    score = F.round(composite(F.col("similarity"), recency(F.col("created_at"), F.col("halflife"), now), F.col("importance"), frequency(F.col("access_count")), boost), 6)
    ranked = scored.select("query", "agent", "id", score.alias("score"), "similarity")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


def context(memories: DataFrame, edges: DataFrame, centers: DataFrame, depth: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """(center, id, depth, rel, weight): memories linked to each center (agent, id) over links among its own agent's memories, walked both ways.

    rel and weight are the type and weight of a link that reached the memory first; of several the least type, then weight. They are null for the center.
    """
    own = memories.select("agent", "id")
    links = edges if kinds is None else edges.where(F.col("type").isin(*kinds))
    inside = links.join(own.select(F.col("agent").alias("a"), F.col("id").alias("src")), "src").join(own.select(F.col("agent").alias("b"), F.col("id").alias("dst")), "dst").where("a = b").select("src", "dst", "type", "weight")
    walked = directed(settled(inside), "BOTH").select(F.col("src").alias("at"), F.col("dst").alias("id"), F.struct("type", "weight").alias("link"))
    start = centers.select("id").distinct().join(own.select("id"), "id", "left_semi").select(F.col("id").alias("center"), "id", F.lit(0).alias("depth"))
    none = F.lit(None).cast(walked.schema["link"].dataType)
    found = start.withColumn("link", none)
    frontier = found.select("center", F.col("id").alias("at"))
    for level in range(1, depth + 1):
        step = walked.join(frontier, "at").select("center", "id", F.lit(level).alias("depth"), "link")
        if level == depth:  # not walked on from, so it is neither cut to what is new nor written
            found = found.unionByName(step)
            break
        new = step.groupBy("center", "id", "depth").agg(F.min("link").alias("link")).join(found.select("center", "id"), ["center", "id"], "left_anti")
        frontier = settled(new.select("center", "id", "depth", "link"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        frontier = frontier.select("center", F.col("id").alias("at"))
    first = found.groupBy("center", "id").agg(F.min(F.struct("depth", "link")).alias("f"))
    return first.select("center", "id", "f.depth", F.col("f.link.type").alias("rel"), F.col("f.link.weight").alias("weight"))


def decay(memories: DataFrame, now: int, prune: float) -> DataFrame:
    """(agent, pruned, remaining, lowest_id, lowest_score): what pruning below a score would do to each agent's memories."""
    scored = memories.select("agent", "id", F.round(retention(now), 6).alias("score"))
    return scored.groupBy("agent").agg(F.count_if(F.col("score") < prune).alias("pruned"), F.count_if(F.col("score") >= prune).alias("remaining"), F.min(F.struct("score", "id")).alias("low")).select("agent", "pruned", "remaining", F.col("low.id").alias("lowest_id"), F.col("low.score").alias("lowest_score"))


def pruned(memories: DataFrame, now: int, prune: float) -> DataFrame:
    """memories without those whose retention is below prune."""
    return memories.where(F.round(retention(now), 6) >= prune)


def memory_list(memories: DataFrame, now: int, sort: str = "recency", kind: str | None = None, limit: int = 10, tag: str | None = None) -> DataFrame:
    """(agent, id, value, rank): each agent's first memories by recency, score or importance, descending."""
    by = {"recency": F.col("created_at").cast("double"), "score": F.round(retention(now), 6), "importance": F.col("importance")}[sort]
    own = memories if kind is None else memories.where(F.col("type") == kind)
    own = own if tag is None else own.where(F.col("tag") == tag)
    listed = own.select("agent", "id", by.alias("value"))
    return listed.withColumn("rank", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("value"), "id"))).where(F.col("rank") <= limit)


def touch(memories: DataFrame, reads: DataFrame) -> DataFrame:
    """memories with access_count raised by the reads (agent, id) of each."""
    n = reads.groupBy("agent", "id").agg(F.count("*").alias("reads"))
    return memories.join(n, ["agent", "id"], "left").withColumn("access_count", F.col("access_count") + F.coalesce("reads", F.lit(0))).drop("reads")
