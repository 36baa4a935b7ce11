"""An engine that holds the model's tables and runs commands on them: engine.execute("GRAPH.TRAVERSE", "a", "DEPTH", "2") gives a frame.

Each command is one call of an operator. Writes make new tables; settle() writes them out, which also ends the growth of their plans.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import collections as col
from orrery.operators import graph, kv, vector
from orrery.session import settled
from orrery.sources import files

SCHEMAS = {
    "log": "seq long, ts_ms long, db int, cmd string, args array<string>",
    "nodes": "key string, type string, props map<string,string>",
    "edges": "edge_id long, src string, dst string, type string, weight double, props map<string,string>",
    "vectors": "key string, field string, vec array<double>",
    "lists": "db int, key string, pos long, value string",
    "hashes": "db int, key string, field string, value string",
    "sets": "db int, key string, member string",
    "zsets": "db int, key string, member string, score double",
    "cache": "key string, response string, threshold double, tag string, expires_at_ms long, vec array<double>",
    "memories": "agent string, id string, text string, type string, importance double, created_at long, access_count long, halflife long, tag string, expires_at_ms long, vec array<double>",
    "subscriptions": "subscriber string, channel string, is_pattern boolean",
}
WRITES = frozenset((*kv.OUTRIGHT, *kv.DEPENDENT, *kv.MANY, *kv.FLUSHES))
DATABASES = 16


def options(args: tuple, *names: str) -> dict[str, str]:
    """The words that follow option names, in any order and case; those without a following word are left out."""
    upper = [str(a).upper() for a in args]
    return {n: args[upper.index(n) + 1] for n in names if n in upper and upper.index(n) + 1 < len(args)}


def _strings(metadata: str) -> dict[str, str]:
    """The members of a JSON object that are strings."""
    read = json.loads(metadata)
    return {k: v for k, v in read.items() if isinstance(v, str)} if isinstance(read, dict) else {}


class Engine:
    """Tables by name, a selected database and a clock that callers set."""

    def __init__(self, spark: SparkSession, now_ms: int = 0, **tables: DataFrame) -> None:
        self.spark, self.now_ms, self.db, self.seq = spark, now_ms, 0, 0
        self.distances: graph.DistanceCache | None = None
        self.tables = {n: tables.get(n) if tables.get(n) is not None else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}

    def settle(self) -> None:
        self.tables = {n: settled(t) for n, t in self.tables.items()}

    def save(self, path: str) -> None:
        files.save_snapshot(self.tables, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, now_ms: int = 0) -> Engine:
        return cls(spark, now_ms, **files.load_snapshot(spark, path, now_ms))

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)

    def one(self, **values) -> DataFrame:
        return self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))

    @property
    def state(self) -> DataFrame:
        return kv.alive(kv.fold(self.tables["log"]), self.now_ms)

    def execute(self, command: str, *args) -> DataFrame:
        """Run one command; names are in any case. A bare string is split at spaces."""
        if not args and " " in command:
            command, *rest = (a or b for a, b in re.findall(r'"([^"]*)"|(\S+)', command))
            args = tuple(rest)
        name = command.upper()
        if name in WRITES:
            return self._write(name, *args)
        run: Callable | None = getattr(self, "do_" + name.lower().replace(".", "_"), None)
        if run is None:
            raise ValueError(f"unknown command {command}")
        return run(*args)

    def _write(self, name: str, *args, db: int | None = None) -> DataFrame:
        """Append a command to the log. Its answer is what the fold of the commands on its keys replies."""
        self.seq += 1
        row = self.rows([(self.seq, self.now_ms, self.db if db is None else db, name, [str(a) for a in args])], SCHEMAS["log"])
        self.tables["log"] = self.tables["log"].unionByName(row)
        if name in ("MSET", "MSETEX", *kv.FLUSHES):
            return self.one(reply="OK")
        if not args:
            raise ValueError(f"wrong number of arguments for {name}")
        keys = [str(a) for a in args] if name in ("DEL", "UNLINK", "MGETDEL") else [str(args[0])]
        own = (F.col("db") == self.db) & F.arrays_overlap("args", F.array(*map(F.lit, keys)))
        return kv.replies(self.tables["log"].where(own | F.col("cmd").isin(*kv.FLUSHES))).where(F.col("seq") == self.seq).select("reply", "error")

    def _value(self, key: str, db: int | None = None):
        """The row (value, expires_at_ms) of a key, or None."""
        return self.state.where((F.col("db") == (self.db if db is None else db)) & (F.col("key") == key)).select("value", "expires_at_ms").first()

    def transaction(self, commands: list[tuple], watch: DataFrame | None = None) -> list[DataFrame] | None:
        """Run commands in order; none if a watched key (db, key, seq) was written since. One command's error doesn't undo the others."""
        from orrery.streaming import watched

        if watch is not None and watched(self.tables["log"], watch).where("changed").limit(1).count():
            return None
        out = []
        for c in commands:
            try:
                out.append(self.execute(*c))
            except ValueError as e:
                out.append(self.one(error=str(e)))
        return out

    def _keys(self, keys) -> DataFrame:
        return self.rows([(i, self.db, k) for i, k in enumerate(keys)], "pos long, db int, key string")

    def _of(self, table: str, key: str) -> DataFrame:
        return self.tables[table].where((F.col("db") == self.db) & (F.col("key") == key))

    # key-value
    def do_select(self, db):
        if not 0 <= int(db) < DATABASES:
            raise ValueError("database index is out of range")
        self.db = int(db)
        return self.one(ok=True)

    def _set_as(self, key: str, row, db: int | None = None, keep_time: bool = False) -> None:
        left = row["expires_at_ms"] - self.now_ms if keep_time and row["expires_at_ms"] is not None else None
        self._write("SET", key, row["value"], *(("PX", left) if left is not None else ()), db=db)

    def do_rename(self, key, to):
        row = self._value(key)
        if row is None:
            raise ValueError("no such key")
        if key != to:
            self._set_as(to, row)
            self._write("DEL", key)
        return self.one(reply="OK")

    def do_renamenx(self, key, to):
        row = self._value(key)
        if row is None:
            raise ValueError("no such key")
        if self._value(to) is not None:
            return self.one(n=0)
        self.do_rename(key, to)
        return self.one(n=1)

    def do_copy(self, key, to, *args):
        row = self._value(key)
        if row is None or (self._value(to) is not None and "REPLACE" not in [str(a).upper() for a in args]):
            return self.one(n=0)
        self._set_as(to, row)
        return self.one(n=1)

    def do_move(self, key, db):
        row = self._value(key)
        if row is None or int(db) == self.db or self._value(key, int(db)) is not None:
            return self.one(n=0)
        self._set_as(key, row, int(db), True)
        self._write("DEL", key)
        return self.one(n=1)

    def do_msetnx(self, *pairs):
        if any(r["n"] for r in self.do_exists(*pairs[::2]).collect()):
            return self.one(n=0)
        self._write("MSET", *pairs)
        return self.one(n=1)

    def do_scanget(self, cursor, *args):
        """SCANGET cursor pattern [COUNT n], or with MATCH before the pattern."""
        o = options(args, "MATCH", "COUNT")
        bare = args[0] if args and str(args[0]).upper() not in ("MATCH", "COUNT") else "*"
        return kv.scan(self.state, self.db, int(cursor), int(o.get("COUNT", 10)), self.now_ms, o.get("MATCH", bare), values=True)

    def do_object(self, what, key):
        if str(what).upper() == "IDLETIME":
            used = self.tables["log"].where((F.col("db") == self.db) & F.array_contains("args", key)).agg(F.max("ts_ms").alias("at"))
            return used.select(F.floor((F.lit(self.now_ms) - F.col("at")) / 1000).cast("long").alias("seconds"))
        return kv.memory_usage(self.state, self.now_ms).where((F.col("db") == self.db) & (F.col("key") == key)).select("encoding")

    def do_get(self, key):
        return kv.get_many(self.state, self._keys([key]), self.now_ms).select("value")

    def do_mget(self, *keys):
        return kv.get_many(self.state, self._keys(keys), self.now_ms).select("pos", "key", "value").orderBy("pos")

    def do_exists(self, *keys):
        return kv.exists(self.state, self._keys(keys), self.now_ms).select("n")

    def do_ttl(self, key):
        return kv.ttl(self.state, self._keys([key]).drop("pos"), self.now_ms).select("ttl")

    def do_pttl(self, key):
        return kv.ttl(self.state, self._keys([key]).drop("pos"), self.now_ms).select("pttl")

    def do_strlen(self, key):
        return kv.strlen(self.state, self.now_ms).where((F.col("db") == self.db) & (F.col("key") == key)).select("length")

    def do_keys(self, pattern):
        return kv.keys(self.state, pattern, self.now_ms).where(F.col("db") == self.db).select("key")

    def do_scan(self, cursor, *args):
        o = options(args, "MATCH", "COUNT")
        return kv.scan(self.state, self.db, int(cursor), int(o.get("COUNT", 10)), self.now_ms, o.get("MATCH", "*"))

    def do_dbsize(self):
        return kv.size(self.state, self.now_ms).where(F.col("db") == self.db).select("n")

    def do_randomkey(self):
        return self.state.where(F.col("db") == self.db).select("key").limit(1)

    def do_type(self, key):
        stores = {"string": self.state} | {k: self.tables[t] for k, t in (("list", "lists"), ("hash", "hashes"), ("set", "sets"), ("zset", "zsets"))}
        return kv.kind_of(stores).where((F.col("db") == self.db) & (F.col("key") == key)).select("type")

    # lists, hashes, sets, sorted sets
    def _push(self, key, values, left: bool):
        old = self._of("lists", key).orderBy("pos")
        log = old.select(F.col("pos").alias("seq"), "db", F.lit("RPUSH").alias("cmd"), F.array("key", "value").alias("args"))
        new = self.rows([(1 << 40, self.db, "LPUSH" if left else "RPUSH", [key, *map(str, values)])], "seq long, db int, cmd string, args array<string>")
        rest = self.tables["lists"].where(~((F.col("db") == self.db) & (F.col("key") == key)))
        self.tables["lists"] = rest.unionByName(col.lists_from_pushes(log.unionByName(new)))
        return self.do_llen(key)

    def do_lpush(self, key, *values):
        return self._push(key, values, True)

    def do_rpush(self, key, *values):
        return self._push(key, values, False)

    def do_llen(self, key):
        return col.list_length(self._of("lists", key)).select("n")

    def do_lindex(self, key, i):
        return col.list_index(self._of("lists", key), int(i)).select("value")

    def do_lrange(self, key, start, stop):
        return col.list_range(self._of("lists", key), int(start), int(stop)).orderBy("pos").select("value")

    def _pop(self, key, n, left):
        own = settled(self._of("lists", key))
        popped, kept = col.list_pop(own, int(n), left)
        self.tables["lists"] = self.tables["lists"].where(~((F.col("db") == self.db) & (F.col("key") == key))).unionByName(kept)
        return popped.orderBy("rank").select("value")

    def _length(self, key: str) -> int:
        row = self.do_llen(key).first()
        if row is None:
            raise ValueError("no such key")
        return row["n"]

    def do_lset(self, key, i, value):
        if not -(n := self._length(key)) <= int(i) < n:
            raise ValueError("index out of range")
        rest = self.tables["lists"].where(~((F.col("db") == self.db) & (F.col("key") == key)))
        self.tables["lists"] = rest.unionByName(col.list_set(self._of("lists", key), int(i), str(value)))
        return self.one(reply="OK")

    def do_lrem(self, key, count, value):
        own = settled(self._of("lists", key))
        kept = settled(col.list_remove(own, str(value), int(count)))
        self.tables["lists"] = self.tables["lists"].where(~((F.col("db") == self.db) & (F.col("key") == key))).unionByName(kept)
        return self.one(n=own.count() - kept.count())

    def do_lpop(self, key, n=1):
        return self._pop(key, n, True)

    def do_rpop(self, key, n=1):
        return self._pop(key, n, False)

    def do_hset(self, key, *pairs):
        new = self.rows([(i, self.db, key, pairs[i], str(pairs[i + 1])) for i in range(0, len(pairs) - 1, 2)], "seq long, db int, key string, field string, value string")
        self.tables["hashes"] = col.hash_set(self.tables["hashes"], new)
        return self.do_hlen(key)

    def do_hget(self, key, field):
        return self._of("hashes", key).where(F.col("field") == field).select("value")

    def do_hmget(self, key, *fields):
        asked = self.rows([(i, self.db, key, f) for i, f in enumerate(fields)], "pos long, db int, key string, field string")
        return col.hash_get(self.tables["hashes"], asked).orderBy("pos").select("field", "value")

    def do_hkeys(self, key):
        return self._of("hashes", key).select("field")

    def do_hvals(self, key):
        return self._of("hashes", key).select("value")

    def do_hexists(self, key, field):
        return self._of("hashes", key).where(F.col("field") == field).agg(F.count("*").alias("n"))

    def do_hgetall(self, key):
        return self._of("hashes", key).select("field", "value")

    def do_hlen(self, key):
        return col.hash_length(self._of("hashes", key)).select("n")

    def do_hdel(self, key, *fields):
        self.tables["hashes"] = col.hash_delete(self.tables["hashes"], self.rows([(self.db, key, f) for f in fields], "db int, key string, field string"))
        return self.do_hlen(key)

    def do_hincrby(self, key, field, n):
        old = self.do_hget(key, field).select(F.col("value").isNotNull() & F.col("value").try_cast("long").isNull()).first()
        if old is not None and old[0]:
            raise ValueError("value is not an integer or out of range")
        self.tables["hashes"] = col.hash_increment(self.tables["hashes"], self.rows([(self.db, key, field, int(n))], "db int, key string, field string, delta long"))
        return self.do_hget(key, field)

    def do_sadd(self, key, *members):
        self.tables["sets"] = col.set_add(self.tables["sets"], self.rows([(self.db, key, str(m)) for m in members], SCHEMAS["sets"]))
        return self.do_scard(key)

    def do_srem(self, key, *members):
        self.tables["sets"] = col.set_remove(self.tables["sets"], self.rows([(self.db, key, str(m)) for m in members], SCHEMAS["sets"]))
        return self.do_scard(key)

    def do_scard(self, key):
        return col.set_size(self._of("sets", key)).select("n")

    def do_smembers(self, key):
        return self._of("sets", key).select("member")

    def do_sismember(self, key, member):
        return self._of("sets", key).where(F.col("member") == str(member)).agg(F.count("*").alias("n"))

    def do_sunion(self, *keys):
        return col.set_union(self.tables["sets"], self.db, list(keys))

    def do_sinter(self, *keys):
        return col.set_intersection(self.tables["sets"], self.db, list(keys))

    def do_sdiff(self, *keys):
        return col.set_difference(self.tables["sets"], self.db, list(keys))

    def do_zadd(self, key, *pairs):
        new = self.rows([(i, self.db, key, str(pairs[i]), str(pairs[i + 1])) for i in range(0, len(pairs) - 1, 2)], "seq long, db int, key string, score string, member string")
        fresh = new.where(F.col("score").try_cast("double").isNotNull()).select("member").distinct().join(self._of("zsets", key).select("member"), "member", "left_anti").count()
        self.tables["zsets"] = col.zset_add(self.tables["zsets"], new)
        return self.one(n=fresh)

    def do_zcard(self, key):
        return self._of("zsets", key).agg(F.count("*").alias("n"))

    def do_zrem(self, key, *members):
        gone = self.rows([(self.db, key, str(m)) for m in members], "db int, key string, member string")
        n = self._of("zsets", key).join(gone.distinct(), ["db", "key", "member"], "left_semi").count()
        self.tables["zsets"] = col.zset_remove(self.tables["zsets"], gone)
        return self.one(n=n)

    def do_zrange(self, key, start, stop, *args):
        out = col.zset_range(self._of("zsets", key), int(start), int(stop)).orderBy("rank")
        return out.select("member", F.format_string("%.6f", "score").alias("score")) if "WITHSCORES" in map(str.upper, args) else out.select("member")

    def do_zrank(self, key, member):
        return col.zset_rank(self._of("zsets", key)).where(F.col("member") == member).select("rank")

    def do_zscore(self, key, member):
        return self._of("zsets", key).where(F.col("member") == member).select(F.format_string("%.6f", "score").alias("score"))

    def do_zcount(self, key, least, most):
        return col.zset_count(self._of("zsets", key), float(least), float(most)).select("n")

    def do_zincrby(self, key, delta, member):
        self.tables["zsets"] = col.zset_increment(self.tables["zsets"], self.rows([(self.db, key, member, float(delta))], "db int, key string, member string, delta double"))
        return self.do_zscore(key, member)

    # graph
    def _seed(self, key):
        return self.rows([(key,)], "key string")

    def do_graph_addnode(self, key, kind):
        if not self.do_graph_getnode(key).isEmpty():
            raise ValueError("DuplicateNode")
        self.tables["nodes"] = graph.add_nodes(self.tables["nodes"], self.rows([(key, kind, {})], SCHEMAS["nodes"]))
        return self.do_graph_getnode(key)

    def do_graph_upsert_node(self, key, kind, metadata="{}"):
        """metadata: JSON; its strings become properties."""
        self.tables["nodes"] = graph.upsert_nodes(self.tables["nodes"], self.rows([(key, kind, _strings(metadata))], SCHEMAS["nodes"]))
        return self.do_graph_getnode(key)

    def do_graph_getnode(self, key):
        return self.tables["nodes"].where(F.col("key") == key)

    def do_graph_setprop(self, key, prop, value):
        self.tables["nodes"] = graph.set_property(self.tables["nodes"], self.rows([(key, prop, str(value), 0)], "key string, prop string, value string, seq long"))
        return self.do_graph_getnode(key)

    def do_graph_delnode(self, key):
        self.tables["nodes"], self.tables["edges"] = graph.delete_nodes(self.tables["nodes"], self.tables["edges"], self._seed(key))
        self.tables["vectors"] = vector.delete_vectors(self.tables["vectors"], self._seed(key))
        return self.do_graph_stats()

    def _next_edge(self) -> int:
        return (self.tables["edges"].agg(F.max("edge_id")).first()[0] or 0) + 1

    def do_graph_addedge(self, src, dst, kind, weight="1.0"):
        if self.tables["nodes"].where(F.col("key").isin(src, dst)).select("key").distinct().count() < len({src, dst}):
            raise ValueError("NodeNotFound")
        new = self.rows([(self._next_edge(), src, dst, kind, str(weight), {})], "edge_id long, src string, dst string, type string, weight string, props map<string,string>")
        self.tables["edges"] = graph.add_edges(self.tables["edges"], new, self.tables["nodes"])
        return self.tables["edges"].where((F.col("src") == src) & (F.col("dst") == dst))

    def do_graph_upsert_edge(self, src, dst, kind, metadata="{}"):
        """metadata: JSON; its strings become the edge's properties, an existing edge's too."""
        new = self.rows([(src, dst, kind, _strings(metadata))], "src string, dst string, type string, props map<string,string>")
        self.tables["nodes"], self.tables["edges"] = graph.upsert_edges(self.tables["nodes"], self.tables["edges"], new)
        return self.tables["edges"].where((F.col("src") == src) & (F.col("dst") == dst))

    def do_graph_deledge(self, edge_id):
        gone = self.rows([(int(edge_id),)], "edge_id long")
        if self.tables["edges"].where(F.col("edge_id") == int(edge_id)).isEmpty():
            raise ValueError("EdgeNotFound")
        self.tables["edges"] = graph.delete_edges(self.tables["edges"], gone)
        return self.one(reply="OK")

    def do_graph_set_edge_prop(self, edge_id, prop, value):
        self.tables["edges"] = graph.set_edge_property(self.tables["edges"], self.rows([(int(edge_id), prop, str(value), 0)], "edge_id long, prop string, value string, seq long"))
        return self.tables["edges"].where(F.col("edge_id") == int(edge_id))

    def do_graph_ingest(self, payload):
        self.tables["nodes"], self.tables["edges"] = graph.ingest(self.tables["nodes"], self.tables["edges"], self.rows([(payload,)], "json string"))
        return self.do_graph_stats()

    def do_graph_stats(self):
        return graph.stats(self.tables["nodes"], self.tables["edges"])

    def do_graph_list_by_type(self, kind, *args):
        o = options(args, "LIMIT")
        return graph.list_by_type(self.tables["nodes"], kind, int(o["LIMIT"]) if o else None)

    def do_graph_neighbors(self, key, direction="OUT"):
        return graph.neighbors(self.tables["nodes"], self.tables["edges"], self._seed(key), direction).drop("seed")

    def do_graph_traverse(self, key, *args):
        o = options(args, "DEPTH", "DIR", "EDGETYPE", "NODETYPE", "LIMIT")
        out = graph.traverse(self.tables["nodes"], self.tables["edges"], self._seed(key), int(o.get("DEPTH", 10)), o.get("DIR", "OUT"), o["EDGETYPE"].split(",") if "EDGETYPE" in o else None, o.get("NODETYPE"), limit=int(o["LIMIT"]) if "LIMIT" in o else None)
        return out.select("key", "type", F.lit("").alias("via"), "depth").orderBy("depth", "key")

    def do_graph_path(self, source, target, *args):
        o = options(args, "MAXDEPTH")
        return graph.shortest_paths(self.tables["nodes"], self.tables["edges"], self.rows([(source, target)], "source string, target string"), int(o.get("MAXDEPTH", 20))).select("hops", "path")

    def do_graph_wpath(self, source, target):
        cache = self.distances if self.distances is not None and self.distances.fresh(self.tables["edges"]) else None
        return graph.weighted_paths(self.tables["nodes"], self.tables["edges"], self.rows([(source, target)], "source string, target string"), cache=cache).select(F.round("weight", 2).alias("weight"), "path")

    def do_graph_chbuild(self, landmarks=graph.LANDMARKS):
        """Keep distances of some landmarks, which WPATH uses until an edge changes."""
        self.distances = graph.DistanceCache.build(self.tables["edges"], int(landmarks))
        return self.do_graph_chstats()

    def do_graph_chstats(self):
        return self.distances.stats(self.tables["edges"]) if self.distances is not None else self.one(state="none")

    def do_graph_impact(self, key, *args):
        o = options(args, "EDGES", "NODES", "DEPTH")
        split = lambda n: o[n].split(",") if n in o else None
        return graph.impact(self.tables["nodes"], self.tables["edges"], self._seed(key), int(o.get("DEPTH", 10)), split("EDGES"), split("NODES")).drop("seed")

    def do_graph_paths(self, key, kind, *args):
        o = options(args, "EDGES", "DEPTH", "MAXDEPTH", "LIMIT")
        return graph.paths(self.tables["nodes"], self.tables["edges"], self._seed(key), kind, int(o.get("DEPTH", o.get("MAXDEPTH", 10))), o["EDGES"].split(",") if "EDGES" in o else None, int(o.get("LIMIT", 100))).drop("seed")

    def do_graph_cooccur(self, prop, *args):
        o = options(args, "TYPE", "WINDOW", "WEIGHT")
        kind = o.get("TYPE", "CO_OCCURS")
        members = self.tables["nodes"].where(F.col("props")[prop].isNotNull()).select(F.col("props")[prop].alias("grp"), "key")
        old, rest = self.tables["edges"].where(F.col("type") == kind), self.tables["edges"].where(F.col("type") != kind)
        new = graph.cooccur(members, float(o.get("WEIGHT", 1)), int(o.get("WINDOW", 50)), old, "INCR" in [str(a).upper() for a in args])
        kept = old.select("edge_id", "src", "dst", "props")
        linked = new.join(kept, ["src", "dst"], "left").withColumn("type", F.lit(kind))
        self.tables["edges"] = rest.unionByName(graph.numbered(linked, self.tables["edges"]).select(*rest.columns))
        return self.tables["edges"].where(F.col("type") == kind)

    # vectors, cache, memories
    def do_graph_setvec(self, key, field, vec):
        self.tables["vectors"] = vector.set_vectors(self.tables["vectors"], self.rows([(key, field, [float(x) for x in vec])], SCHEMAS["vectors"]), self.tables["nodes"])
        return self.do_graph_getvec(key, field)

    def do_graph_getvec(self, key, field):
        return self.tables["vectors"].where((F.col("key") == key) & (F.col("field") == field)).select("vec")

    def _query(self, vec):
        return self.rows([("q", [float(x) for x in vec])], "query string, vec array<double>")

    def do_graph_vecsearch(self, field, vec, *args):
        return vector.search(self.tables["vectors"].where(F.col("field") == field), self._query(vec), int(options(args, "K").get("K", 5))).orderBy("rank").select("key", "score")

    def do_graph_rag(self, field, vec, *args):
        o = options(args, "K", "DEPTH", "DIR", "EDGETYPE", "NODETYPE")
        found = vector.rag(self.tables["nodes"], self.tables["edges"], self.tables["vectors"].where(F.col("field") == field), self._query(vec), int(o.get("K", 5)), int(o.get("DEPTH", 1)), o.get("DIR", "OUT"), o.get("EDGETYPE"), o.get("NODETYPE"))
        return found.join(self.tables["nodes"].select("key", "props"), "key", "left").select("key", "score", "props", "neighbors").orderBy(F.desc("score"), "key")

    def do_cache_semset(self, key, response, vec, *args):
        o = options(args, "EX", "PX", "THRESHOLD", "TAG")
        ends = self.now_ms + (int(o["EX"]) * 1000 if "EX" in o else int(o["PX"])) if {"EX", "PX"} & set(o) else None
        new = self.rows([(key, response, float(o.get("THRESHOLD", 0.95)), o.get("TAG"), ends, [float(x) for x in vec], 0)], SCHEMAS["cache"] + ", seq long")
        self.tables["cache"] = vector.cache_set(self.tables["cache"], new)
        return self.one(ok=True)

    def do_cache_semget(self, vec, *args):
        o = options(args, "THRESHOLD", "COUNT")
        return vector.cache_get(self.tables["cache"], self._query(vec), self.now_ms, float(o["THRESHOLD"]) if "THRESHOLD" in o else None, int(o.get("COUNT", 1))).drop("query")

    def do_cache_seminval(self, *args):
        o = options(args, "TAG")
        self.tables["cache"] = vector.cache_invalidate(self.tables["cache"], None if o else args[0], o.get("TAG"))
        return self.tables["cache"].agg(F.count("*").alias("entries"))

    def do_cache_semclear(self):
        self.tables["cache"] = self.tables["cache"].limit(0)
        return self.one(ok=True)

    def do_cache_semstats(self, *probes):
        """Entries of the cache, and hits and misses of some vectors."""
        asked = self.rows([(str(i), [float(x) for x in v]) for i, v in enumerate(probes)], "query string, vec array<double>")
        return vector.cache_stats(self.tables["cache"], asked, self.now_ms)

    def do_subscribe(self, subscriber, *channels, pattern=False):
        new = self.rows([(subscriber, c, pattern) for c in channels], SCHEMAS["subscriptions"])
        self.tables["subscriptions"] = self.tables["subscriptions"].unionByName(new).distinct()
        return self.tables["subscriptions"].where(F.col("subscriber") == subscriber).agg(F.count("*").alias("n"))

    def do_psubscribe(self, subscriber, *patterns):
        return self.do_subscribe(subscriber, *patterns, pattern=True)

    def do_unsubscribe(self, subscriber, *channels, pattern=False):
        gone = (F.col("subscriber") == subscriber) & (F.col("is_pattern") == pattern) & (F.col("channel").isin(*channels) if channels else F.lit(True))
        self.tables["subscriptions"] = self.tables["subscriptions"].where(~gone)
        return self.tables["subscriptions"].where(F.col("subscriber") == subscriber).agg(F.count("*").alias("n"))

    def do_punsubscribe(self, subscriber, *patterns):
        return self.do_unsubscribe(subscriber, *patterns, pattern=True)

    def do_publish(self, channel, payload):
        """How many receive a message; streaming.publish() gives the deliveries."""
        from orrery.streaming import receivers

        return receivers(self.rows([(0, channel, str(payload))], "seq long, channel string, payload string"), self.tables["subscriptions"]).select("receivers")

    def do_memory_store(self, agent, text, *args):
        o = options(args, "ID", "TYPE", "IMPORTANCE", "HALFLIFE", "TAG", "VEC", "TTL", "SOURCE")
        self.seq += 1
        ends = self.now_ms + int(o["TTL"]) * 1000 if "TTL" in o else None
        row = (agent, o.get("ID"), text, o.get("TYPE", "episodic"), float(o.get("IMPORTANCE", 0.5)), self.now_ms // 1000, 0, int(o.get("HALFLIFE", 604800)), o.get("TAG"), ends, [float(x) for x in o.get("VEC", [])], self.seq)
        new = settled(vector.named_memories(self.tables["memories"], self.rows([row], SCHEMAS["memories"] + ", seq long")))
        self.tables["memories"] = vector.memory_store(self.tables["memories"], new)
        name = new.first()["id"]
        if "SOURCE" in o:
            self._link(name, str(o["SOURCE"]), "SOURCED_FROM", 1.0, {"type": "source"})
        return self.one(id=name)

    def _link(self, src: str, dst: str, kind: str, weight: float, stub: dict | None = None) -> DataFrame:
        if stub is not None:
            self.tables["nodes"] = graph.add_nodes(self.tables["nodes"], self.rows([(dst, stub["type"], {})], SCHEMAS["nodes"]))
        edge = self.rows([(self._next_edge(), src, dst, kind, weight, {})], SCHEMAS["edges"])
        self.tables["edges"] = self.tables["edges"].unionByName(edge)
        return edge

    @property
    def memories(self) -> DataFrame:
        """The memories whose time isn't over."""
        return self.tables["memories"].where(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > self.now_ms))

    def do_memory_recall(self, agent, vec, *args):
        o = options(args, "LIMIT", "THRESHOLD", "TYPE", "AFTER", "BEFORE", "BOOST", "TAG")
        asked = self.rows([("q", agent, [float(x) for x in vec])], "query string, agent string, vec array<double>")
        whole = lambda n: int(o[n]) if n in o else None
        found = vector.recall(self.memories, asked, self.now_ms // 1000, int(o.get("LIMIT", 10)), float(o.get("THRESHOLD", 0.5)), o.get("TYPE"), whole("AFTER"), whole("BEFORE"), o["BOOST"].lower() if "BOOST" in o else None, o.get("TAG"))
        return found.join(self.tables["memories"].select("agent", "id", "text", "type", "importance", "created_at"), ["agent", "id"]).drop("query", "agent").orderBy("rank")

    def do_memory_relate(self, agent, a, b, kind, *args):
        return self._link(a, b, kind, float(options(args, "WEIGHT").get("WEIGHT", 1)))

    def do_memory_context(self, agent, id_, *args):
        o = options(args, "DEPTH", "TYPES")
        center = self.rows([(agent, id_)], "agent string, id string")
        found = vector.context(self.memories, self.tables["edges"], center, int(o.get("DEPTH", 2)), o["TYPES"].split(",") if "TYPES" in o else None)
        about = self.memories.where(F.col("agent") == agent).select("id", "text", "type")
        return found.drop("center").join(about, "id").orderBy("depth", "id")

    def do_memory_decay(self, agent, *args):
        limit = float(options(args, "PRUNE").get("PRUNE", 0))
        own = self.tables["memories"].where(F.col("agent") == agent)
        out = settled(vector.decay(own, self.now_ms // 1000, limit).drop("agent"))
        if "DRY_RUN" not in [str(a).upper() for a in args]:
            self.tables["memories"] = self.tables["memories"].where(F.col("agent") != agent).unionByName(vector.pruned(own, self.now_ms // 1000, limit))
        return out

    def do_memory_list(self, agent, *args):
        o = options(args, "TYPE", "LIMIT", "SORT", "TAG")
        return vector.memory_list(self.memories.where(F.col("agent") == agent), self.now_ms // 1000, o.get("SORT", "recency").lower(), o.get("TYPE"), int(o.get("LIMIT", 10)), o.get("TAG")).drop("agent").orderBy("rank")

    def do_memory_get(self, agent, id_):
        key = self.rows([(agent, id_)], "agent string, id string")
        self.tables["memories"] = vector.touch(self.tables["memories"], key)
        return self.tables["memories"].join(key, ["agent", "id"], "left_semi")

    def do_memory_del(self, agent, id_):
        n = self.memories.where((F.col("agent") == agent) & (F.col("id") == id_)).count()
        self.tables["memories"] = self.tables["memories"].where(~((F.col("agent") == agent) & (F.col("id") == id_)))
        return self.one(n=n)
