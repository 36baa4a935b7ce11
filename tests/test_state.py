"""Key-value folding, collections, vectors, cache, memories, files and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from orrery import streaming
from orrery.functions import glob_pattern
from orrery.operators import collections as col
from orrery.operators import kv, vector
from orrery.sources import files


def log(spark, *commands, db=0):
    rows = [(i, ts, db, c[0], list(c[1:])) for i, (ts, c) in enumerate((x if isinstance(x, tuple) else (0, x.split())) for x in commands)]
    return spark.createDataFrame(rows, "seq long, ts_ms long, db int, cmd string, args array<string>")


def folded(spark, *commands):
    return {r["key"]: (r["value"], r["expires_at_ms"]) for r in kv.fold(log(spark, *commands)).collect()}


def test_fold(spark):
    assert folded(spark, "SET a 1", "SET a 2") == {"a": ("2", None)}
    assert folded(spark, "INCR n", "INCRBY n 5", "DECR n") == {"n": ("5", None)}
    assert folded(spark, "SET n x", "INCR n") == {"n": ("x", None)}
    assert folded(spark, "SET a 1", "DEL a b", "SETNX a 3", "SETNX a 4") == {"a": ("3", None)}
    assert folded(spark, "SET a 1 NX", "SET a 2 NX", "SET b 1 XX") == {"a": ("1", None)}
    assert folded(spark, "APPEND s ab", "APPEND s cd") == {"s": ("abcd", None)}
    assert folded(spark, "MSET a 1 b 2", "DEL a") == {"b": ("2", None)}
    assert folded(spark, "SET a 1", "FLUSHDB", "SET b 1") == {"b": ("1", None)}
    assert folded(spark, "SET a 1 EX 10", "PERSIST a") == {"a": ("1", None)}
    assert folded(spark, "SET a 1", "EXPIRE a 10", "EXPIRE none 10") == {"a": ("1", 10_000)}
    assert folded(spark, (0, ["SET", "a", "1", "PX", "5"]), (6, ["SETNX", "a", "2"])) == {"a": ("2", None)}
    assert folded(spark, (0, ["SET", "a", "1", "PX", "5"]), (5, ["SETNX", "a", "2"])) == {"a": ("1", 5)}
    assert folded(spark, "SET n 9223372036854775807", "INCR n") == {"n": ("9223372036854775807", None)}
    assert folded(spark, "SET a 1 EX 1", "INCR a") == {"a": ("2", None)}
    assert folded(spark) == {}


def replied(spark, *commands):
    return [(r["cmd"], r["reply"], r["error"]) for r in kv.replies(log(spark, *commands)).orderBy("seq").collect()]


def test_replies(spark):
    got = replied(spark, "SET a 5", "INCR a", "INCRBY a 10", "APPEND a 0", "GETSET a 9", "SETNX a 1", "DEL a b", "SETNX a 1", "GETDEL a", "GETDEL a", "GET a")
    assert got == [("SET", "OK", None), ("INCR", "6", None), ("INCRBY", "16", None), ("APPEND", "3", None), ("GETSET", "160", None), ("SETNX", "0", None), ("DEL", "1", None), ("SETNX", "1", None), ("GETDEL", "1", None), ("GETDEL", None, None), ("GET", None, None)]
    got = replied(spark, "SET a x", "INCR a", "EXPIRE a 10", "EXPIRE none 10", "EXPIRE a soon", "PERSIST a", "SETEX a 0 y", "SETEX a soon y", "GET a", "STRLEN a")
    assert [r[1] for r in got] == ["OK", None, "1", "0", None, "1", None, None, "x", "1"] and [r[2] is not None for r in got] == [False, True, False, False, True, False, True, True, False, False]
    got = replied(spark, "MSETEX a 1 10 b 2 20", "INCRTTL a 4 EX 7", "INCRTTL n", "GETEX b PERSIST", "MGETDEL a none b", "FLUSHDB", "EXISTS a", "GET n")
    assert [(c, r) for c, r, _ in got] == [("MSETEX", "OK"), ("INCRTTL", "5"), ("INCRTTL", "1"), ("GETEX", "2"), ("MGETDEL", '["5",null,"2"]'), ("GET", None)]
    assert replied(spark, "SET n 9223372036854775807", "INCR n", "GET n")[1:] == [("INCR", None, kv.NOT_A_NUMBER), ("GET", "9223372036854775807", None)]
    assert replied(spark, (0, ["SET", "a", "1", "PX", "5"]), (5, ["GET", "a"]), (6, ["GET", "a"])) == [("SET", "OK", None), ("GET", "1", None), ("GET", None, None)]
    assert folded(spark, "MSETEX a 1 10 b 2 20", "GETEX a EX 3", "GETEX b PX 5", "INCRTTL c 2 EX 9") == {"a": ("1", 3000), "b": ("2", 5), "c": ("2", 9000)}
    assert folded(spark, "SET a 1", "SETEX a 0 x", "SETEX a 5 y") == {"a": ("y", 5000)} and folded(spark, "SET a 1", "SETEX a no x") == {"a": ("1", None)}
    assert kv.counters(log(spark, "SET a 5", "INCR a", "INCRBY a 10")).orderBy("seq").first()["value"] == 6
    assert kv.old_values(log(spark, "APPEND a 16", "APPEND a 0", "GETSET a 9")).first()["old"] == "160"


def test_ranks_of_one_large_key(spark):
    """One key over many ranges: places and sums as a plain window gives them."""
    from pyspark.sql import Window

    from orrery.operators.ranks import ranked, running

    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("key"), (F.col("id") * 7919 % 5003).alias("at"))
    order = Window.partitionBy("key").orderBy(F.desc("at"))
    want = sorted(tuple(r) for r in rows.select(F.coalesce("key", F.lit(-1)), "at", (F.row_number().over(order) - 1).cast("long"), F.sum("at").over(order)).collect())
    got = running(ranked(rows, ["key"], [F.desc("at")]), ["key"], [F.desc("at")], F.col("at"), "total")
    assert sorted(tuple(r) for r in got.select(F.coalesce("key", F.lit(-1)), "at", "rank", "total").collect()) == want


def test_snapshots_switch_by_marker(spark, tmp_path):
    path = str(tmp_path / "snap")
    one = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="no snapshot"):
        files.load_snapshot(spark, path)
    files.save_snapshot({"t": one}, path)
    one.selectExpr("x + 1 AS x").write.parquet(f"{path}/data-2/t")  # a save that broke off before its marker
    assert files.load_snapshot(spark, path)["t"].first()["x"] == 1
    files.save_snapshot({"t": one.selectExpr("x + 2 AS x")}, path)
    assert files.load_snapshot(spark, path)["t"].first()["x"] == 3
    with pytest.raises(ValueError, match="none of"):
        files.rewrite({}, 0)
    lists = col.lists_from_pushes(log(spark, "RPUSH l b c", "LPUSH l a z"))
    again = col.lists_from_pushes(files.rewrite({"lists": lists}, 0))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, lists.collect()))


def test_namespaces_and_glob(spark):
    both = log(spark, "SET k 0").unionByName(log(spark, "SET k 1", db=1))
    assert {(r["db"], r["value"]) for r in kv.fold(both).collect()} == {(0, "0"), (1, "1")}
    state = kv.fold(log(spark, "SET a.b 1", "SET axb 1", "SET a[1] 1"))
    assert {r["key"] for r in kv.keys(state, "a.?", 0).collect()} == {"a.b"}
    assert {r["key"] for r in kv.keys(state, "a[1]", 0).collect()} == {"a[1]"}


def test_scan_pages(spark):
    state = kv.fold(log(spark, *(f"SET k{i} v" for i in range(5))))
    pages, cursor = [], 0
    while True:
        page = kv.scan(state, 0, cursor, 2, 0).collect()
        pages += [r["key"] for r in page]
        cursor = page[0]["next"]
        if not cursor:
            break
    assert pages == [f"k{i}" for i in range(5)]


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_log(log(spark, "SET a 1", "SET b 1 PX 5"), path)
    files.append_log(log(spark, "SET c 1").withColumn("seq", F.lit(10).cast("long")), path)
    assert {r["key"] for r in files.replay_log(spark, path, 100).collect()} == {"a", "c"}
    state = kv.fold(spark.read.parquet(path))
    assert sorted(map(tuple, kv.fold(files.compact(state, 3)).collect())) == sorted(map(tuple, state.collect()))
    files.save_snapshot({"kv": state}, str(tmp_path / "snap"))
    assert files.load_snapshot(spark, str(tmp_path / "snap"), 100)["kv"].count() == 2


def test_vector_files(spark, tmp_path):
    path = str(tmp_path / "v")
    v = spark.createDataFrame([("a", "f", [3.0, 4.0]), ("b", "g", [0.0, 0.0, 0.0]), ("c", "f", None)], "key string, field string, vec array<double>")
    files.save_vectors(v, path)
    got = {(r["key"], r["field"]): [round(x, 6) for x in r["vec"]] for r in files.load_vectors(spark, path).collect()}
    assert got == {("a", "f"): [0.6, 0.8], ("b", "g"): [0.0, 0.0, 0.0]} and files.load_vectors(spark, path, "g").count() == 1


def test_stream_fold(spark, tmp_path):
    source = str(tmp_path / "in")
    files.append_log(log(spark, "SET a 1", "INCR a"), source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        streaming.fold_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(60)
    assert [tuple(r) for r in streaming.read_stream_state(spark, str(tmp_path / "state"), 0).select("key", "value").collect()] == [("a", "2")]
    files.append_log(log(spark, "SET b 1 PX 50", "INCR a").withColumn("seq", F.col("seq") + 10), source)
    streaming.fold_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(60)
    state = lambda now: sorted(tuple(r) for r in streaming.read_stream_state(spark, str(tmp_path / "state"), now).collect())
    assert state(0) == [(0, "a", "3", None), (0, "b", "1", 50)] and state(51) == [(0, "a", "3", None)]


def test_patterns(spark):
    subs = spark.createDataFrame([("a", "news.*", True), ("a", "news.x", False), ("b", "n?ws.x", True), ("c", "news", False)], "subscriber string, channel string, is_pattern boolean")
    messages = spark.createDataFrame([(1, "news.x", "p"), (2, "news", "p")], "seq long, channel string, payload string")
    assert {(r["seq"], r["receivers"]) for r in streaming.receivers(messages, subs).collect()} == {(1, 2), (2, 1)}


def test_lists(spark):
    pushes = log(spark, "RPUSH l b c", "LPUSH l a z")
    lists = col.lists_from_pushes(pushes)
    values = lambda df: [r["value"] for r in df.orderBy("pos").collect()]
    assert values(lists) == ["z", "a", "b", "c"]
    assert values(col.list_range(lists, -2, -1)) == ["b", "c"] and values(col.list_range(lists, 2, 1)) == []
    assert values(col.list_set(lists, -1, "x")) == ["z", "a", "b", "x"]
    assert col.list_index(lists, 9).count() == 0
    repeated = col.lists_from_pushes(log(spark, "RPUSH l x a x b x"))
    assert values(col.list_remove(repeated, "x", 2)) == ["a", "b", "x"] and values(col.list_remove(repeated, "x", -1)) == ["x", "a", "x", "b"] and values(col.list_remove(repeated, "x")) == ["a", "b"]


def test_zsets(spark):
    z = col.zset_add(spark.createDataFrame([], "db int, key string, member string, score double"), spark.createDataFrame([(i, 0, "z", s, m) for i, (s, m) in enumerate([("30", "c"), ("10", "a"), ("20", "b"), ("oops", "d"), ("10", "A")])], "seq long, db int, key string, score string, member string"))
    assert [r["member"] for r in col.zset_rank(z).orderBy("rank").collect()] == ["A", "a", "b", "c"]
    assert col.zset_count(z, 10, 20).first()["n"] == 3 and col.zset_count(z, 50, 100).first()["n"] == 0
    assert [r["member"] for r in col.zset_range(z, 1, -2).orderBy("rank").collect()] == ["a", "b"]


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0]), ("c", [0.0, 1.0, 0.0]), ("o", [0.0, 0.0, 0.0])], "key string, vec array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.0, 0.0])], "query string, vec array<double>")
    assert [(r["key"], r["score"]) for r in vector.search(v, q, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.9939), ("c", 0.0)]
    assert vector.search(v, q.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.search(v, spark.createDataFrame([("q", [1.0])], "query string, vec array<double>"), 1).collect()


def test_many_blocks_of_queries(spark, monkeypatch):
    rows = spark.range(60).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.array(*(F.sin(F.col("id") * k).alias("x") for k in range(1, 4))).alias("vec"))
    asked = rows.withColumnRenamed("key", "query")
    want = sorted(tuple(r) for r in vector.search(rows, asked, 3).collect())
    monkeypatch.setattr(vector, "BLOCK_BYTES", 24 * 7)
    monkeypatch.setattr(vector, "MAX_QUERIES", 2)
    more = rows.unionByName(rows.limit(1).select(F.lit("null").alias("key"), F.lit(None).cast("array<double>").alias("vec")))
    assert sorted(tuple(r) for r in vector.search(more, asked, 3).collect()) == want and len(want) == 180


def test_memories_are_numbered_on(spark):
    none = spark.createDataFrame([], "agent string, id string, text string")
    new = lambda *texts: spark.createDataFrame([("x", None, t, i) for i, t in enumerate(texts)], "agent string, id string, text string, seq long")
    stored = vector.memory_store(vector.memory_store(none, new("a", "b")), new("c"))
    assert sorted(tuple(r) for r in stored.collect()) == [("x", "mem:x:1", "a"), ("x", "mem:x:2", "b"), ("x", "mem:x:3", "c")]


def test_cache(spark):
    cache = spark.createDataFrame([("k1", "hello", 0.95, "g", None, [1.0, 0.0]), ("k2", "old", 0.1, None, 10, [0.0, 1.0])], "key string, response string, threshold double, tag string, expires_at_ms long, vec array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "query string, vec array<double>")
    assert [tuple(r) for r in vector.cache_get(cache, q, 10).collect()] == [("x", "k1", "hello", 1.0)]
    assert tuple(vector.cache_stats(cache, q, 10).first()) == (1, 1, 2) and tuple(vector.cache_stats(cache, q, 9).first()) == (2, 0, 2)
    assert vector.cache_invalidate(cache, tag="g").count() == 1 and vector.cache_invalidate(cache, key="nope").count() == 2


def test_memory_scores(spark):
    m = spark.createDataFrame([("x", "lo", "t", 0.2, 1000, 0, 100, [1.0, 0.0]), ("x", "hi", "t", 0.9, 1000, 1023, 100, [1.0, 0.0]), ("y", "other", "t", 1.0, 1000, 0, 0, [1.0, 0.0])], "agent string, id string, type string, importance double, created_at long, access_count long, halflife long, vec array<double>")
    q = spark.createDataFrame([("q", "x", [1.0, 0.0])], "query string, agent string, vec array<double>")
    got = {r["id"]: r["score"] for r in vector.recall(m, q, 1100).collect()}
    assert got == {"hi": 0.45, "lo": 0.05}  # recency 0.5; frequency 1 and 0.5
    assert {r["id"]: r["score"] for r in vector.recall(m, q, 1100, boost="recency").collect()}["hi"] == 0.225
    assert {r["agent"]: (r["pruned"], r["lowest_id"]) for r in vector.decay(m, 1100, 0.1).collect()} == {"x": (1, "lo"), "y": (0, "other")}


def test_embedding(spark):
    from orrery.sources.embedding import embed

    texts = spark.createDataFrame([("a", "Red cars, fast"), ("b", "fast red cars"), ("c", "slow boats"), ("d", None)], "key string, text string")
    vectors = embed(texts)
    query = embed(spark.createDataFrame([("q", "red cars fast!")], "query string, text string"))
    got = [(r["key"], r["score"]) for r in vector.search(vectors, query, 2).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 1.0)]
    assert embed(texts, embedder=lambda xs: [[float(len(x))] for x in xs]).where("key = 'd'").first()["vec"] == [0.0]


def test_context_writes_no_last_level(spark, monkeypatch):
    """Memories in a chain: the links and the first level are written, and nothing else of which there are as many rows as memories."""
    import orrery.operators.graph
    import orrery.session

    written = []
    settled = orrery.session.settled
    counted = lambda df: (out := settled(df), written.append(out.count()))[0]
    monkeypatch.setattr(orrery.operators.graph, "settled", counted)
    monkeypatch.setattr(vector, "settled", counted, raising=False)
    m = spark.range(20).select(F.lit("a").alias("agent"), F.format_string("m%02d", "id").alias("id"))
    e = spark.range(19).select(F.format_string("m%02d", "id").alias("src"), F.format_string("m%02d", F.col("id") + 1).alias("dst"), F.when(F.col("id") % 2 == 0, "next").otherwise("then").alias("type"), F.lit(1.0).alias("weight"))
    got = {(r["center"], r["id"]): (r["depth"], r["rel"]) for r in vector.context(m, e, m, 2).collect()}
    assert len(got) == 20 + 2 * 19 + 2 * 18 and got["m05", "m05"] == (0, None) and got["m05", "m06"] == (1, "then") and got["m05", "m03"] == (2, "then")
    assert sum(written) <= 19 + 38


def test_removing_few_deals_nothing_by_range(spark, monkeypatch):
    """A bounded count removes the same as places counted anew do, without writing the lists."""
    from orrery.operators import ranks

    rows = spark.range(400).select(F.lit(0).alias("db"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("key"), F.floor(F.col("id") / 3).cast("long").alias("pos"), F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("id").cast("string")).alias("value"))
    all_of = lambda n: sorted(tuple(r) for r in col.list_remove(rows, "x", n).select("db", "key", "pos", "value").collect())
    monkeypatch.setattr(col, "MAX_PLACES", 0, raising=False)
    want = {n: all_of(n) for n in (1, -1, 4, -4, 1000)}
    monkeypatch.setattr(col, "MAX_PLACES", 1000, raising=False)
    monkeypatch.setattr(ranks, "settled", None)
    assert {n: all_of(n) for n in want} == want
