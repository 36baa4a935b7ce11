"""Vector, cache and memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import normalize
from orrery.operators import approximate, vector
from orrery.plans.registry import register
from orrery.sources.adapters import memories, table, vectors

NOW = 1706745600
DOT = "list_sum([z[1]::DOUBLE * z[2]::DOUBLE for z in list_zip({a}, {b})])"


def cos(a: str, b: str) -> str:
    return f"round({DOT.format(a=a, b=b)} / (sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)})), 4)"


V = "v AS (SELECT 'vec:' || vec_id AS key, vec_id AS id, label, embedding AS vec FROM embeddings)"
SEARCH = f"s AS (SELECT q.key AS query, x.key, {cos('q.vec', 'x.vec')} AS score FROM v x, v q WHERE q.id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS INTEGER) AS rank FROM s)"


def asked(spark, d):
    return vectors(spark, d).where("id % 50 = 0").select(F.col("key").alias("query"), "vec")


@register(f"WITH {V}, {SEARCH} SELECT query, key, score, rank FROM r WHERE rank <= 10")
def vector_search(spark, d):
    return vector.search(vectors(spark, d), asked(spark, d), 10)


@register(f"WITH {V} SELECT key, round(list_sum([x::DOUBLE for x in vec]) / sqrt({DOT.format(a='vec', b='vec')}), 6) AS total FROM v")
def vector_get(spark, d):
    stored = vectors(spark, d).select("key", normalize(F.col("vec")).alias("vec"))
    return stored.select("key", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register(f"WITH {V} SELECT 'f' || (id % 2) AS field, count(*) AS n FROM v WHERE NOT (id % 2 = 1 AND label < 3) GROUP BY ALL")
def vector_delete(spark, d):
    v = vectors(spark, d).select("key", F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("field"), "vec", "label")
    return vector.delete_vectors(v, v.where("label < 3"), "f1").groupBy("field").agg(F.count("*").alias("n"))


@register(f"""WITH {V}, {SEARCH}, h AS (SELECT query, key, score FROM r WHERE rank <= 3),
e AS (SELECT 'vec:' || vec_id AS src, 'vec:' || (vec_id * 7 + 1) % 500 AS dst FROM embeddings UNION ALL SELECT 'vec:' || vec_id, 'vec:' || (vec_id * 3 + 2) % 500 FROM embeddings),
w AS (SELECT h.query, h.key, e.dst FROM h JOIN e ON e.src = h.key UNION SELECT h.query, h.key, f.dst FROM h JOIN e ON e.src = h.key JOIN e f ON f.src = e.dst)
SELECT h.query, h.key, h.score, coalesce(string_agg(DISTINCT w.dst, ',' ORDER BY w.dst), '') AS neighbors FROM h LEFT JOIN w ON w.query = h.query AND w.key = h.key AND w.dst <> h.key GROUP BY ALL""")
def graph_rag(spark, d):
    v = vectors(spark, d)
    link = lambda a, b: v.select(F.col("key").alias("src"), F.concat(F.lit("vec:"), ((F.col("id") * a + b) % 500).cast("string")).alias("dst"), F.lit("near").alias("type"), F.lit(1.0).alias("weight"))
    found = vector.rag(v.select("key", F.lit("vector").alias("type")), link(7, 1).unionByName(link(3, 2)), v, asked(spark, d), 3, 2)
    return found.withColumn("neighbors", F.array_join("neighbors", ","))


@register()
def vector_search_approx(spark, d):
    """Through an index whose probes are chosen for a recall of 0.9; what it finds depends on the centres, so it has no SQL, and tests measure the recall."""
    v = vectors(spark, d).select("key", "vec")
    return approximate.find(approximate.tuned(approximate.build(v), asked(spark, d), 10), asked(spark, d), 10)


CACHE = "c AS (SELECT 'vec:' || vec_id AS key, 'answer ' || vec_id AS response, 0.2 + (vec_id % 4) / 10.0 AS threshold, 't' || label AS tag, CASE WHEN vec_id % 7 = 0 THEN 1000 END AS expires_at_ms, embedding AS vec FROM embeddings)"
PROBE = "p AS (SELECT 'vec:' || vec_id AS query, embedding AS vec FROM embeddings WHERE vec_id % 50 = 0)"
HITS = f"""s AS (SELECT query, key, response, threshold, expires_at_ms, {cos('p.vec', 'c.vec')} AS score FROM c, p), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s),
h AS (SELECT query, arg_min(key, rank) AS key, arg_min(response, rank) AS response, arg_min(score, rank) AS score FROM r WHERE rank <= 3 AND (expires_at_ms IS NULL OR 2000 < expires_at_ms) AND score >= threshold GROUP BY query)"""


def cache(spark, d):
    e = table(spark, d, "embeddings")
    number = F.col("vec_id").cast("string")
    return e.select(F.concat(F.lit("vec:"), number).alias("key"), F.concat(F.lit("answer "), number).alias("response"), (0.2 + (F.col("vec_id") % 4) / 10).alias("threshold"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("tag"), F.when(F.col("vec_id") % 7 == 0, 1000).cast("long").alias("expires_at_ms"), F.col("embedding").alias("vec"))


def probes(spark, d):
    return vectors(spark, d).where("id % 50 = 0").select(F.col("key").alias("query"), "vec")


@register(f"WITH {CACHE}, {PROBE}, {HITS} SELECT query, key, response, score FROM h")
def cache_get(spark, d):
    return vector.cache_get(cache(spark, d), probes(spark, d), 2000, count=3)


@register(f"WITH {CACHE}, {PROBE}, {HITS} SELECT (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM p) - (SELECT count(*) FROM h) AS misses, (SELECT count(*) FROM c) AS entries")
def cache_stats(spark, d):
    return vector.cache_stats(cache(spark, d), probes(spark, d), 2000, count=3)


@register(f"WITH {CACHE} SELECT key, response FROM c WHERE tag <> 't3'")
def cache_invalidate(spark, d):
    return vector.cache_invalidate(cache(spark, d), tag="t3").select("key", "response")


@register(f"WITH {CACHE}, n AS (SELECT 'vec:' || 2 * vec_id AS key FROM embeddings) SELECT key, response FROM c WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, 'new' FROM n")
def cache_set(spark, d):
    """Half of the keys written are there already; each is written twice."""
    old = cache(spark, d)
    new = old.withColumn("key", F.concat(F.lit("vec:"), (2 * F.split("key", ":")[1].cast("long")).cast("string")))
    writes = new.withColumn("response", F.lit("older")).withColumn("seq", F.lit(1)).unionByName(new.withColumn("response", F.lit("new")).withColumn("seq", F.lit(2)))
    return vector.cache_set(old, writes).select("key", "response")


M = """m AS (SELECT 'agent:' || user_id AS agent, 'mem:' || event_id AS id, event_id, event_type AS type, event_type || ' ' || event_id AS text, least(value / 100, 1.0) AS importance, CAST(floor(epoch(ts)) AS BIGINT) AS created_at,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS access_count, 604800 AS halflife, embedding AS vec FROM events JOIN embeddings ON vec_id = event_id % 500)"""
RECENCY = f"pow(0.5::DOUBLE, greatest({NOW} - created_at, 0)::DOUBLE / halflife)"
FREQUENCY = "(0.5 + 0.5 * least(1.0, log2(access_count + 1.0) / 10.0))"
KEEP = f"round({RECENCY} * importance * {FREQUENCY}, 6)"


def recalled(where: str, score: str, threshold: float, limit: int) -> str:
    return f"""WITH {M}, q AS (SELECT 'agent:' || vec_id AS query, embedding AS q FROM embeddings),
s AS (SELECT query, agent, id, {cos('vec', 'q')} AS similarity, importance, created_at, halflife, access_count FROM m JOIN q ON query = agent WHERE {where}),
t AS (SELECT query, agent, id, similarity, round({score}, 6) AS score FROM s WHERE similarity >= {threshold}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM t) SELECT query, agent, id, score, similarity, rank FROM r WHERE rank <= {limit}"""


def askers(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("agent:"), F.col("vec_id").cast("string")).alias("query"), F.concat(F.lit("agent:"), F.col("vec_id").cast("string")).alias("agent"), F.col("embedding").alias("vec"))


@register(recalled("true", f"similarity * {RECENCY} * importance * {FREQUENCY}", 0.05, 5))
def memory_recall(spark, d):
    return vector.recall(memories(spark, d), askers(spark, d), NOW, 5, 0.05)


@register(recalled("type = 'click' AND created_at BETWEEN 1704500000 AND 1706000000", f"similarity * {RECENCY} * {RECENCY} * importance * {FREQUENCY}", 0.0, 3))
def memory_recall_filtered(spark, d):
    return vector.recall(memories(spark, d), askers(spark, d), NOW, 3, 0.0, "click", 1704500000, 1706000000, "recency")


@register(f"WITH {M}, s AS (SELECT agent, id, {KEEP} AS score FROM m) SELECT agent, count(*) FILTER (score < 0.05) AS pruned, count(*) FILTER (score >= 0.05) AS remaining, arg_min(id, (score, id)) AS lowest_id, min(score) AS lowest_score FROM s GROUP BY agent")
def memory_decay(spark, d):
    return vector.decay(memories(spark, d), NOW, 0.05)


@register(f"WITH {M} SELECT agent, count(*) AS n FROM m WHERE {KEEP} >= 0.2 GROUP BY agent")
def memory_prune(spark, d):
    return vector.pruned(memories(spark, d), NOW, 0.2).groupBy("agent").agg(F.count("*").alias("n"))


@register(f"WITH {M}, r AS (SELECT agent, id, {KEEP} AS value, CAST(row_number() OVER (PARTITION BY agent ORDER BY {KEEP} DESC, id) AS INTEGER) AS rank FROM m WHERE type = 'purchase') SELECT * FROM r WHERE rank <= 4")
def memory_list(spark, d):
    return vector.memory_list(memories(spark, d), NOW, "score", "purchase", 4)


CONTEXT = f"""WITH RECURSIVE {M}, l AS (SELECT agent, id AS src, lead(id) OVER (PARTITION BY agent ORDER BY event_id) AS dst, CASE WHEN event_id % 2 = 0 THEN 'next' ELSE 'then' END AS type, 1.0::DOUBLE + event_id % 3 AS weight FROM m),
w AS (SELECT src, dst, type, weight FROM l WHERE dst IS NOT NULL UNION ALL SELECT dst, src, type, weight FROM l WHERE dst IS NOT NULL),
b(center, id, depth) AS (SELECT id, id, 0 FROM m UNION SELECT b.center, w.dst, b.depth + 1 FROM b JOIN w ON w.src = b.id WHERE b.depth < 2),
t AS (SELECT center, id, min(depth) AS depth FROM b GROUP BY ALL), f AS (SELECT t.center, w.dst AS id, t.depth + 1 AS depth, min((w.type, w.weight)) AS link FROM t JOIN w ON w.src = t.id GROUP BY ALL)
SELECT t.center, t.id, t.depth, f.link[1] AS rel, f.link[2] AS weight FROM t LEFT JOIN f USING (center, id, depth)"""


@register(CONTEXT)
def memory_context(spark, d):
    from pyspark.sql import Window

    m = memories(spark, d).drop("vec")
    kind, weight = F.when(F.col("event_id") % 2 == 0, "next").otherwise("then"), 1.0 + F.col("event_id") % 3
    chain = m.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("agent").orderBy("event_id")).alias("dst"), kind.alias("type"), weight.alias("weight")).where("dst IS NOT NULL")
    return vector.context(m, chain, m.select("agent", "id"), 2)


@register("WITH e AS (SELECT 'agent:' || user_id AS agent, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) AS n, event_type AS type FROM events) SELECT agent, 'mem:' || agent || ':' || n AS id, type FROM e")
def memory_store(spark, d):
    """Two batches, of which the second goes on from the numbers of the first."""
    m = memories(spark, d).select("agent", "id", "type", "event_id")
    new = m.select("agent", F.lit(None).cast("string").alias("id"), "type", F.col("event_id").alias("seq"))
    first = vector.memory_store(m.limit(0).select("agent", "id", "type"), new.where("seq % 2 = 0"))
    return vector.memory_store(first, new.where("seq % 2 = 1"))


@register(f"WITH {M}, t AS (SELECT 'mem:' || (event_id % 100) AS id, count(*) AS n FROM events GROUP BY ALL) SELECT agent, id, CAST(access_count + coalesce(n, 0) AS BIGINT) AS access_count FROM m LEFT JOIN t USING (id)")
def memory_get(spark, d):
    m = memories(spark, d).select("agent", "id", "event_id", "access_count")
    reads = m.select(F.concat(F.lit("mem:"), (F.col("event_id") % 100).cast("string")).alias("id")).join(m.select("agent", "id"), "id")
    return vector.touch(m, reads).select("agent", "id", "access_count")
