"""Small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph


def make(spark, nodes, edges):
    n = spark.createDataFrame([tuple(x.split(":")) for x in nodes], "key string, type string")
    return n, spark.createDataFrame([(a, b, t, float(w)) for a, t, b, w in edges], "src string, dst string, type string, weight double")


def seeds(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def depths(df):
    return {r["key"]: r["depth"] for r in df.collect()}


CHAIN = (["a:t", "b:t", "c:t"], [("a", "link", "b", 1), ("b", "link", "c", 1)])


def test_chain_and_depth(spark):
    n, e = make(spark, *CHAIN)
    assert depths(graph.traverse(n, e, seeds(spark, "a"), 5)) == {"a": 0, "b": 1, "c": 2}
    assert depths(graph.traverse(n, e, seeds(spark, "a"), 1)) == {"a": 0, "b": 1}
    assert depths(graph.traverse(n, e, seeds(spark, "c"), 5, "IN")) == {"c": 0, "b": 1, "a": 2}
    assert depths(graph.traverse(n, e, seeds(spark, "nobody"), 5)) == {}


def test_cycle_self_loop_and_parallel_edges(spark):
    n, e = make(spark, ["a:t", "b:t"], [("a", "x", "b", 1), ("a", "x", "b", 1), ("b", "x", "a", 1), ("a", "x", "a", 1)])
    assert depths(graph.traverse(n, e, seeds(spark, "a"), 10)) == {"a": 0, "b": 1}
    assert sorted(r["key"] for r in graph.neighbors(n, e, seeds(spark, "a")).collect()) == ["a", "b"]


def test_edge_types_and_node_type(spark):
    n, e = make(spark, ["a:service", "b:api", "c:table"], [("a", "calls", "b", 1), ("b", "reads_from", "c", 1)])
    reach = lambda **k: set(depths(graph.traverse(n, e, seeds(spark, "a"), 2, **k)))
    assert reach() == {"a", "b", "c"}
    assert reach(edge_types=["calls"]) == {"a", "b"}
    assert reach(edge_types=["NOPE", "ALSO_NOPE"]) == {"a"}
    assert reach(node_type="table") == {"a"}  # prunes: b is neither returned nor expanded
    assert reach(node_type="nothing") == {"a"}
    assert reach(node_type="nothing", strict_compat=True) == {"a", "b", "c"}


def test_diamond_shortest_path(spark):
    n, e = make(spark, ["a:t", "b:t", "c:t", "d:t"], [("a", "link", "b", 1), ("b", "link", "c", 1), ("a", "link", "d", 1), ("d", "link", "c", 1)])
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "a")], "source string, target string")
    got = {(r["source"], r["target"]): (r["hops"], r["path"]) for r in graph.shortest_paths(n, e, pairs, 10).collect()}
    assert got == {("a", "c"): (2, ["a", "b", "c"]), ("c", "a"): (2, ["c", "b", "a"]), ("a", "a"): (0, ["a"])}
    assert graph.shortest_paths(n, e, pairs.where("target = 'c'"), 1).count() == 0


def test_weighted_paths(spark):
    n, e = make(spark, [f"{x}:t" for x in "abcde"], [("a", "l", "b", 1), ("b", "l", "c", 2), ("a", "l", "c", 10), ("c", "l", "d", 1), ("d", "l", "e", 1), ("a", "l", "e", 20)])
    pairs = spark.createDataFrame([("a", "e"), ("e", "a")], "source string, target string")
    assert [tuple(r) for r in graph.weighted_paths(n, e, pairs).collect()] == [("a", "e", 5.0, ["a", "b", "c", "d", "e"])]
    with pytest.raises(ValueError, match="negative"):
        graph.weighted_paths(n, e.withColumn("weight", -F.col("weight")), pairs)


def test_weighted_paths_equal_dijkstra(spark):
    import heapq

    links = [(f"n{i}", "e", f"n{(i + 7 * j + 1) % 100}", (3 * i + 5 * j) % 10 + 1) for i in range(100) for j in range(3)]
    n, e = make(spark, [f"n{i}:t" for i in range(100)], links)
    asked = [(f"n{7 * i % 100}", f"n{(13 * i + 50) % 100}") for i in range(50)]
    got = {(r["source"], r["target"]): r["weight"] for r in graph.weighted_paths(n, e, spark.createDataFrame(asked, "source string, target string")).collect()}
    out = {}
    for a, _, b, w in links:
        out.setdefault(a, []).append((b, w))
    for source, target in set(asked):
        best, heap = {}, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if x not in best:
                best[x] = d
                for y, w in out[x]:
                    heapq.heappush(heap, (d + w, y))
        assert got.get((source, target)) == best.get(target)


def test_impact(spark):
    n, e = make(spark, ["root:service", "a:service", "c:service", "b:database"], [("root", "depends_on", "a", 1), ("root", "depends_on", "b", 1), ("a", "depends_on", "c", 1)])
    count = lambda **k: {r["type"]: r["cnt"] for r in graph.impact(n, e, seeds(spark, "root"), **k).collect()}
    assert count() == {"total": 3, "service": 2, "database": 1}
    assert count(node_types=["database"]) == {"total": 1, "database": 1}
    assert count(edge_types=["NOPE"]) == {}


def test_paths(spark):
    n, e = make(spark, ["start:service", "mid:service", "end:deployment"], [("start", "depends_on", "mid", 1), ("mid", "deploys_to", "end", 1), ("mid", "depends_on", "start", 1)])
    assert [r["path"] for r in graph.paths(n, e, seeds(spark, "start"), "deployment").collect()] == [["start", "mid", "end"]]
    assert graph.paths(n, e, seeds(spark, "start"), "nonexistent").count() == 0


def test_cooccur(spark):
    members = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "c"), ("c2", "d")], "grp string, key string")
    first = graph.cooccur(members)
    assert first.count() == 3
    assert {r["weight"] for r in graph.cooccur(members, existing=first, increment=True).collect()} == {2.0}
    assert {r["weight"] for r in graph.cooccur(members, existing=first).collect()} == {1.0}
    assert graph.cooccur(members, window=2).count() == 0


def test_ingest_both_spellings(spark):
    none = spark.createDataFrame([], "key string, type string, props map<string,string>")
    no_edges = spark.createDataFrame([], "src string, dst string, type string, weight double")
    payloads = [
        '{"nodes":[{"id":"n1","node_type":"test","metadata":{"k":"v1","n":3}},{"id":"n2","node_type":"test"},{"type":"no id"}],"edges":[{"from_id":"n1","to_id":"n2","edge_type":"linked"}]}',
        '{"nodes":[{"id":"a","type":"test"}],"edges":[{"from":"a","to":"b","type":"linked"},{"from":"a","to":"b","type":"linked"}]}',
        "not json",
    ]
    n, e = graph.ingest(none, no_edges, spark.createDataFrame([(p,) for p in payloads], "json string"))
    assert {r["key"]: (r["type"], r["props"]) for r in n.collect()} == {"n1": ("test", {"k": "v1"}), "n2": ("test", {}), "a": ("test", {}), "b": ("unknown", None)}
    assert sorted(tuple(r)[:3] for r in e.collect()) == [("a", "b", "linked"), ("n1", "n2", "linked")]


def test_upsert_keeps_type_and_delete_cascades(spark):
    old = spark.createDataFrame([("a", "t1", {"x": "1", "y": "1"})], "key string, type string, props map<string,string>")
    new = spark.createDataFrame([("a", "t2", {"x": "2"}), ("b", "t2", {})], "key string, type string, props map<string,string>")
    assert {r["key"]: (r["type"], r["props"]) for r in graph.upsert_nodes(old, new).collect()} == {"a": ("t1", {"x": "2", "y": "1"}), "b": ("t2", {})}
    n, e = make(spark, *CHAIN)
    left, rest = graph.delete_nodes(n, e, seeds(spark, "b"))
    assert left.count() == 2 and rest.count() == 0


def test_weighted_paths_end_only_when_settled(spark):
    n, e = make(spark, [f"{x}:t" for x in "abcde"], [("a", "l", "b", 1), ("b", "l", "c", 1), ("c", "l", "d", 1), ("d", "l", "e", 1), ("a", "l", "e", 9)])
    pairs = spark.createDataFrame([("a", "e")], "source string, target string")
    assert [r["weight"] for r in graph.weighted_paths(n, e, pairs).collect()] == [4]
    with pytest.raises(ValueError, match="rounds"):
        graph.weighted_paths(n, e, pairs, max_rounds=2)


def test_distance_cache(spark):
    """Bounds by way of landmarks change no path; a changed edge makes the cache stale."""
    links = [(f"n{i}", "e", f"n{(i + 7 * j + 1) % 60}", (3 * i + 5 * j) % 10 + 1) for i in range(60) for j in range(3)]
    n, e = make(spark, [f"n{i}:t" for i in range(60)], links)
    pairs = spark.createDataFrame([(f"n{7 * i % 60}", f"n{(13 * i + 5) % 60}") for i in range(20)], "source string, target string")
    cache = graph.DistanceCache.build(e, 4)
    rows = lambda df: sorted(tuple(r) for r in df.select("source", "target", "weight").collect())
    assert rows(graph.weighted_paths(n, e, pairs, cache=cache)) == rows(graph.weighted_paths(n, e, pairs))
    exact = {(r["source"], r["key"]): r["weight"] for r in graph.distances(e, pairs).collect()}
    assert all(exact[s, t] == w for s, t, w in rows(graph.weighted_paths(n, e, pairs)))
    stats = cache.stats(e).first()
    assert (stats["state"], stats["edges"], stats["landmarks"], stats["entries"]) == ("fresh", 180, 4, 2 * 4 * 60)
    changed = e.withColumn("weight", F.when(F.col("src") == "n0", 9.0).otherwise(F.col("weight")))
    assert cache.stats(changed).first()["state"] == "stale"
    with pytest.raises(ValueError, match="stale"):
        graph.weighted_paths(n, changed, pairs, cache=cache)


def test_new_ids_go_on_from_old_ones(spark):
    """Old ids that differ each time they are computed, as those that depend on a plan's partitions do; new ones go on from the ids that the edges keep."""
    n = spark.createDataFrame([], "key string, type string")
    link = F.concat(F.lit("a"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("dst"), F.lit("t").alias("type")
    old = spark.range(20).select(F.expr("CAST(reflect('java.lang.System', 'nanoTime') AS long)").alias("edge_id"), *link, F.lit(1.0).alias("weight"))
    _, e = graph.upsert_edges(n, old, spark.range(50).select(*link))
    is_old = F.regexp_extract("src", r"\d+", 0).cast("int") < 20
    most, least, count = e.agg(F.max(F.when(is_old, F.col("edge_id"))), F.min(F.when(~is_old, F.col("edge_id"))), F.count("*")).first()
    assert count == 50 and least > most


def test_long_frontiers_are_sieved(spark, monkeypatch):
    """Steps of frontiers that aren't broadcast give the same paths, and what a sieve lets through holds all that is wanted."""
    rows = spark.range(1000).select(F.col("id").cast("string").alias("src"))
    wanted = rows.where("src % 10 = 0")
    kept = {r["src"] for r in graph.sieved(rows, wanted, ["src"]).collect()}
    assert {str(i) for i in range(0, 1000, 10)} <= kept and len(kept) < 110
    n, e = make(spark, [f"{x}:t" for x in "abcdef"], [("a", "l", "b", 1), ("b", "l", "c", 1), ("a", "l", "d", 1), ("d", "l", "c", 1), ("c", "l", "e", 1), ("e", "l", "f", 1)])
    pairs = spark.createDataFrame([("a", "f"), ("a", "c"), ("b", "d"), ("f", "b")], "source string, target string")
    monkeypatch.setattr(graph, "MAX_FRONTIER", 0)
    got = {(r["source"], r["target"]): (r["hops"], len(r["path"]), r["path"][0], r["path"][-1]) for r in graph.shortest_paths(n, e, pairs).collect()}
    assert got == {("a", "f"): (4, 5, "a", "f"), ("a", "c"): (2, 3, "a", "c"), ("b", "d"): (2, 3, "b", "d"), ("f", "b"): (3, 4, "f", "b")}


def test_weighted_paths_write_no_edges(spark, monkeypatch):
    """Edges that no path needs, of which there are many, aren't written; frontiers that aren't broadcast give the same path."""
    n, e = make(spark, [f"{x}:t" for x in "abc"], [("a", "l", "b", 1), ("a", "l", "b", 3), ("b", "l", "c", 2), ("a", "l", "c", 10)])
    e = e.unionByName(spark.range(500).select(F.col("id").cast("string").alias("src"), F.lit("a").alias("dst"), F.lit("l").alias("type"), F.lit(1.0).alias("weight")))
    pairs = spark.createDataFrame([("a", "c")], "source string, target string")
    written, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (out := settled(df), written.append(out.count()))[0])
    for most in (graph.MAX_FRONTIER, 0):
        monkeypatch.setattr(graph, "MAX_FRONTIER", most)
        assert [tuple(r) for r in graph.weighted_paths(n, e, pairs).collect()] == [("a", "c", 3.0, ["a", "b", "c"])]
    assert max(written) <= 3
