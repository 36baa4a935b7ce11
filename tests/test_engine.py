import pytest

from orrery.engine import Engine


@pytest.fixture
def engine(spark):
    return Engine(spark, now_ms=1_000_000)


def values(df):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]


def test_strings(engine):
    engine.execute("SET a 1")
    engine.execute("INCRBY", "a", 4)
    assert values(engine.execute("get a")) == ["5"] and values(engine.execute("MGET", "a", "b")) == [(0, "a", "5"), (1, "b", None)]
    engine.execute("EXPIRE a 10")
    assert values(engine.execute("TTL a")) == [10]
    engine.now_ms += 20_000
    assert values(engine.execute("TTL a")) == [-2]
    engine.execute("SELECT 3")
    assert values(engine.execute("KEYS *")) == []
    with pytest.raises(ValueError, match="unknown command"):
        engine.execute("NOPE x")


def test_collections(engine):
    engine.execute("RPUSH l a b")
    engine.execute("LPUSH l c d")
    assert values(engine.execute("LRANGE l 0 -1")) == ["d", "c", "a", "b"]
    assert values(engine.execute("RPOP l 2")) == ["b", "a"] and values(engine.execute("LLEN l")) == [2]
    engine.execute("ZADD z 3 c 1 a 2 b")
    assert values(engine.execute("ZRANGE z 0 1 WITHSCORES")) == [("a", "1.000000"), ("b", "2.000000")]
    engine.execute("HSET h f 1")
    assert values(engine.execute("HINCRBY h f 4")) == ["5"]
    engine.execute("SADD s x y"), engine.execute("SADD t y")
    assert values(engine.execute("SDIFF s t")) == ["x"]


def test_graph_and_vectors(engine, tmp_path, spark):
    for k in "abc":
        engine.execute("GRAPH.ADDNODE", k, "service")
    engine.execute("GRAPH.ADDEDGE a b calls 2"), engine.execute("GRAPH.ADDEDGE b c calls")
    engine.settle()
    assert values(engine.execute("GRAPH.TRAVERSE a DEPTH 1").select("key")) == ["a", "b"]
    assert values(engine.execute("GRAPH.WPATH a c").select("weight")) == [3.0]
    assert values(engine.execute("GRAPH.PATH c a").select("hops")) == [2]
    engine.execute("GRAPH.SETVEC", "a", "v", [2, 0]), engine.execute("GRAPH.SETVEC", "b", "v", [0, 1])
    assert values(engine.execute("GRAPH.RAG", "v", [1, 0], "K", 1).select("key", "neighbors")) == [("a", ["b"])]
    engine.save(str(tmp_path / "s"))
    assert values(Engine.load(spark, str(tmp_path / "s")).execute("GRAPH.VECSEARCH", "v", [0, 1], "K", 1)) == [("b", 1.0)]


def test_cache_memory_and_transactions(engine):
    engine.execute("CACHE.SEMSET", "k", "hello", [1, 0, 0], "TAG", "g")
    assert values(engine.execute("CACHE.SEMGET", [1, 0, 0])) == [("k", "hello", 1.0)] and values(engine.execute("CACHE.SEMGET", [0, 1, 0])) == []
    engine.execute("MEMORY.STORE", "al", "x", "ID", "m1", "VEC", [1, 0], "IMPORTANCE", 0.9)
    engine.execute("MEMORY.STORE", "al", "y", "ID", "m2", "VEC", [1, 0], "IMPORTANCE", 0.2)
    assert values(engine.execute("MEMORY.RECALL", "al", [1, 0]).select("id")) == ["m1", "m2"]
    engine.execute("MEMORY.DECAY", "al", "PRUNE", 0.2)
    assert values(engine.execute("MEMORY.LIST", "al").select("id")) == ["m1"]
    engine.execute("SET w 1")
    watch = engine.rows([(0, "w", engine.seq)], "db int, key string, seq long")
    assert len(engine.transaction([("SET", "w", "2"), ("NOPE",)], watch)) == 2
    assert engine.transaction([("SET", "w", "3")], watch) is None and values(engine.execute("GET w")) == ["2"]


def test_replies_of_writes(engine):
    answer = lambda *c: values(engine.execute(*c).select("reply"))
    assert answer("SET a 5") == ["OK"] and answer("INCR a") == ["6"] and answer("APPEND a 0") == ["2"] and answer("GETSET a 9") == ["60"]
    assert answer("SETNX a 1") == ["0"] and answer("DEL a b") == ["1"] and answer("SETNX a 1") == ["1"] and answer("EXPIRE none 5") == ["0"]
    assert engine.execute("INCRBY a x").first()["error"]
    engine.settle()
    assert values(engine.execute("MSETNX a 1 c 2")) == [0] and values(engine.execute("MSETNX c 1 d 2")) == [1] and values(engine.execute("GET d")) == ["2"]
    assert values(engine.execute("RENAME d e")) == ["OK"] and values(engine.execute("GET e")) == ["2"] and values(engine.execute("EXISTS d")) == [0]
    engine.settle()
    assert values(engine.execute("RENAMENX e a")) == [0] and values(engine.execute("COPY e a")) == [0] and values(engine.execute("COPY e a REPLACE")) == [1] and values(engine.execute("GET a")) == ["2"]
    engine.settle()
    assert values(engine.execute("MOVE e 5")) == [1] and values(engine.execute("EXISTS e")) == [0]
    for wrong in ("RENAME nobody x", "SELECT 16", "LSET l 0 x"):
        with pytest.raises(ValueError):
            engine.execute(wrong)
    engine.execute("SELECT 5")
    assert values(engine.execute("GET e")) == ["2"] and [tuple(r)[:2] for r in engine.execute("SCANGET 0 e*").collect()] == [("e", "2")]


def test_more_of_collections(engine):
    engine.execute("RPUSH l a b a")
    assert values(engine.execute("LSET l -1 z")) == ["OK"] and values(engine.execute("LREM l 0 a")) == [1] and values(engine.execute("LRANGE l 0 -1")) == ["b", "z"]
    with pytest.raises(ValueError, match="index"):
        engine.execute("LSET l 5 x")
    assert values(engine.execute("ZADD z 1 a 2 b")) == [2] and values(engine.execute("ZADD z 3 a 1 c")) == [1] and values(engine.execute("ZCARD z")) == [3] and values(engine.execute("ZREM z a nobody")) == [1]
    engine.execute("HSET h f 1 g x")
    assert sorted(values(engine.execute("HKEYS h"))) == ["f", "g"] and sorted(values(engine.execute("HVALS h"))) == ["1", "x"] and values(engine.execute("HEXISTS h f")) == [1]
    assert values(engine.execute("HMGET h g none")) == [("g", "x"), ("none", None)]
    with pytest.raises(ValueError, match="integer"):
        engine.execute("HINCRBY h g 1")
    engine.execute("SADD s x")
    assert values(engine.execute("SISMEMBER s x")) == [1] and values(engine.execute("SISMEMBER s y")) == [0]


def test_edges_and_errors(engine):
    engine.execute("GRAPH.ADDNODE a t"), engine.execute("GRAPH.ADDNODE b t")
    with pytest.raises(ValueError, match="DuplicateNode"):
        engine.execute("GRAPH.ADDNODE a t")
    with pytest.raises(ValueError, match="NodeNotFound"):
        engine.execute("GRAPH.ADDEDGE a nobody r")
    first = engine.execute("GRAPH.ADDEDGE a b r 2").first()["edge_id"]
    engine.execute("GRAPH.UPSERT_EDGE", "a", "b", "r", '{"since": "2020", "n": 3}')
    engine.execute("GRAPH.UPSERT_EDGE", "a", "c", "r", '{"since": "2021"}')
    engine.settle()
    edges = {(r["src"], r["dst"]): (r["edge_id"], r["weight"], r["props"]) for r in engine.tables["edges"].collect()}
    assert edges["a", "b"] == (first, 2.0, {"since": "2020"}) and edges["a", "c"][1:] == (1.0, {"since": "2021"}) and len({e[0] for e in edges.values()}) == 2
    assert engine.execute("GRAPH.TRAVERSE a DEPTH 1").columns == ["key", "type", "via", "depth"] and values(engine.execute("GRAPH.TRAVERSE a DEPTH 3 LIMIT 2").select("key")) == ["a", "b"]
    assert values(engine.execute("GRAPH.DELEDGE", first)) == ["OK"] and values(engine.execute("GRAPH.NEIGHBORS a").select("key")) == ["c"]
    with pytest.raises(ValueError, match="EdgeNotFound"):
        engine.execute("GRAPH.DELEDGE 999")


def test_more_of_memories_and_messages(engine):
    one = values(engine.execute("MEMORY.STORE", "al", "x", "VEC", [1, 0], "TAG", "g", "SOURCE", "doc1"))
    two = values(engine.execute("MEMORY.STORE", "al", "y", "VEC", [1, 0], "TTL", 10))
    assert (one, two) == (["mem:al:1"], ["mem:al:2"])
    engine.execute("MEMORY.RELATE", "al", "mem:al:1", "mem:al:2", "FOLLOWS", "WEIGHT", 2)
    engine.settle()
    assert values(engine.execute("MEMORY.RECALL", "al", [1, 0], "TAG", "g").select("id")) == one and values(engine.execute("MEMORY.LIST", "al", "TAG", "none")) == []
    near = engine.execute("MEMORY.CONTEXT", "al", "mem:al:1", "DEPTH", 1, "TYPES", "FOLLOWS").where("depth = 1").first()
    assert (near["id"], near["rel"], near["weight"], near["text"]) == ("mem:al:2", "FOLLOWS", 2.0, "y")
    engine.now_ms += 20_000
    assert values(engine.execute("MEMORY.LIST", "al").select("id")) == one and values(engine.execute("MEMORY.DEL", "al", "mem:al:1")) == [1]
    assert values(engine.execute("SUBSCRIBE me news")) == [1] and values(engine.execute("PSUBSCRIBE you n*s")) == [1]
    assert values(engine.execute("PUBLISH news hello")) == [2] and values(engine.execute("PUBLISH other hello")) == [0]
