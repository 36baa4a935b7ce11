"""Key-value queries on a log made from events, and on state made from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import kv
from orrery.plans.registry import register
from orrery.sources.adapters import command_log, table

NOW = 10_000
STATE = """state AS (SELECT CAST(c_nationkey % 3 AS INTEGER) AS db, 'cust:' || c_custkey AS key, c_name || '/' || c_mktsegment AS value, CASE WHEN c_custkey % 5 = 0 THEN 9000 + c_custkey % 40 * 100 END AS expires_at_ms FROM customer),
live AS (SELECT * FROM state WHERE expires_at_ms IS NULL OR 10000 <= expires_at_ms)"""


def state(spark, d):
    c = table(spark, d, "customer")
    return c.select((F.col("c_nationkey") % 3).cast("int").alias("db"), F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.concat("c_name", F.lit("/"), "c_mktsegment").alias("value"), F.when(F.col("c_custkey") % 5 == 0, 9000 + F.col("c_custkey") % 40 * 100).cast("long").alias("expires_at_ms"))


LOG = """log AS (SELECT event_id AS seq, CAST(user_id % 2 AS INTEGER) AS db, 'user:' || user_id AS key, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)"""
LAST = "last AS (SELECT db, key, max(seq) FILTER (event_type IN ('signup', 'error')) AS since FROM log GROUP BY ALL)"


@register(f"""WITH {LOG}, {LAST}, r AS (SELECT log.db, log.key, sum(k) FILTER (event_type IN ('signup', 'click')) AS n FROM log JOIN last USING (db, key) WHERE since IS NULL OR seq >= since GROUP BY ALL)
SELECT db, key, CAST(n AS VARCHAR) AS value FROM r WHERE n IS NOT NULL""")
def kv_fold(spark, d):
    return kv.fold(command_log(spark, d)).select("db", "key", "value")


@register(f"""WITH {LOG}, e AS (SELECT *, count(*) FILTER (event_type IN ('signup', 'error')) OVER (PARTITION BY db, key ORDER BY seq) AS epoch FROM log WHERE event_type IN ('signup', 'error', 'click')),
r AS (SELECT seq, db, key, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE k END) OVER (PARTITION BY db, key, epoch ORDER BY seq) AS value FROM e) SELECT seq, db, key, CAST(value AS BIGINT) AS value FROM r WHERE event_type = 'click'""")
def kv_incr(spark, d):
    return kv.counters(command_log(spark, d))


@register(f"""WITH {LOG}, e AS (SELECT seq, db, key, event_type, CASE WHEN event_type <> 'error' THEN CAST(k AS VARCHAR) END AS v FROM log WHERE event_type IN ('signup', 'error', 'click')),
r AS (SELECT *, lag(v) OVER (PARTITION BY db, key ORDER BY seq) AS old FROM e) SELECT seq, db, key, old FROM r WHERE event_type = 'click'""")
def kv_getset(spark, d):
    log = command_log(spark, d).withColumn("cmd", F.when(F.col("cmd") == "INCRBY", "GETSET").otherwise(F.col("cmd")))
    return kv.old_values(log)


@register(f"""WITH {LOG}, a AS (SELECT db, key, string_agg(CAST(k AS VARCHAR) || ',', '' ORDER BY seq) AS value FROM log WHERE event_type = 'view' GROUP BY ALL) SELECT db, key, CAST(strlen(value) AS BIGINT) AS length FROM a""")
def kv_append_strlen(spark, d):
    log = command_log(spark, d).where("cmd = 'SADD'")
    log = log.withColumn("args", F.array(F.col("args")[0], F.concat(F.regexp_extract(F.col("args")[1], r"(\d+)$", 1), F.lit(",")))).withColumn("cmd", F.lit("APPEND"))
    return kv.strlen(kv.fold(log), NOW)


@register(f"WITH {LOG} SELECT db, key, CAST(arg_min(k, seq) AS VARCHAR) AS value FROM log WHERE event_type = 'signup' GROUP BY ALL")
def kv_setnx(spark, d):
    log = command_log(spark, d).where("cmd = 'SET'").withColumn("cmd", F.lit("SETNX"))
    return kv.fold(log).select("db", "key", "value")


@register(f"""WITH {LOG}, m AS (SELECT count(*) AS n, max(seq) AS since FROM log WHERE event_type = 'signup' AND k = 13 AND db = 0)
SELECT db, key, CAST(arg_max(k, seq) AS VARCHAR) AS value FROM log, m WHERE event_type = 'signup' AND NOT (db = 0 AND n > 0 AND seq <= since) GROUP BY ALL""")
def kv_flush(spark, d):
    log = command_log(spark, d).where("cmd = 'SET'")
    last = (F.col("args")[1] == "13") & (F.col("db") == 0)
    return kv.fold(log.withColumn("cmd", F.when(last, "FLUSHDB").otherwise("SET"))).select("db", "key", "value")


@register(f"WITH {STATE} SELECT db, key, value FROM live WHERE key IN ('cust:3', 'cust:5', 'cust:20')")
def kv_get(spark, d):
    return kv.alive(state(spark, d), NOW).where(F.col("key").isin("cust:3", "cust:5", "cust:20")).select("db", "key", "value")


ASKED = "asked AS (SELECT i AS pos, CAST(i % 3 AS INTEGER) AS db, 'cust:' || (i * 7 % 400) AS key FROM range(0, 300) t(i))"


def wanted(spark):
    return spark.range(300).select(F.col("id").alias("pos"), (F.col("id") % 3).cast("int").alias("db"), F.concat(F.lit("cust:"), (F.col("id") * 7 % 400).cast("string")).alias("key"))


@register(f"WITH {STATE}, {ASKED} SELECT pos, asked.db, asked.key, value FROM asked LEFT JOIN live USING (db, key)")
def kv_mget(spark, d):
    return kv.get_many(state(spark, d), wanted(spark), NOW)


@register(f"WITH {STATE}, {ASKED} SELECT asked.db, count(live.key) AS n FROM asked LEFT JOIN live USING (db, key) GROUP BY ALL")
def kv_exists(spark, d):
    return kv.exists(state(spark, d), wanted(spark), NOW)


@register(f"WITH {STATE}, {ASKED} SELECT db, count(*) AS n FROM live WHERE (db, key) NOT IN (SELECT (db, key) FROM asked) GROUP BY db")
def kv_del(spark, d):
    return kv.size(kv.delete(state(spark, d), wanted(spark)), NOW)


@register(f"""WITH {STATE}, {ASKED}, p AS (SELECT asked.db, asked.key, CASE WHEN live.key IS NULL THEN -2 WHEN expires_at_ms IS NULL THEN -1 ELSE expires_at_ms - 10000 END AS pttl FROM asked LEFT JOIN live USING (db, key))
SELECT db, key, CAST(CASE WHEN pttl < 0 THEN pttl ELSE pttl // 1000 END AS BIGINT) AS ttl, CAST(pttl AS BIGINT) AS pttl FROM p""")
def kv_ttl(spark, d):
    return kv.ttl(state(spark, d), wanted(spark), NOW)


@register(f"WITH {STATE} SELECT db, count(*) AS n FROM live GROUP BY db")
def kv_dbsize(spark, d):
    return kv.size(state(spark, d), NOW)


@register(f"WITH {STATE} SELECT db, key FROM live WHERE key LIKE 'cust:1_5%'")
def kv_keys(spark, d):
    return kv.keys(state(spark, d), "cust:1?5*", NOW)


@register(f"WITH {STATE}, m AS (SELECT key FROM live WHERE db = 1 AND key LIKE 'cust:%'), n AS (SELECT count(*) AS n FROM m) SELECT key, CAST(CASE WHEN n > 30 THEN 30 ELSE 0 END AS BIGINT) AS next FROM m, n ORDER BY key LIMIT 20 OFFSET 10")
def kv_scan(spark, d):
    return kv.scan(state(spark, d), 1, 10, 20, NOW, "cust:*")


@register(f"WITH {STATE} SELECT key, value, 20::BIGINT AS next FROM live WHERE db = 1 ORDER BY key LIMIT 20")
def kv_scanget(spark, d):
    return kv.scan(state(spark, d), 1, 0, 20, NOW, values=True)


@register(f"WITH {STATE} SELECT db, CASE WHEN key LIKE 'cust:2%' THEN 'moved:' || key ELSE key END AS key, value, CASE WHEN key LIKE 'cust:2%' THEN NULL ELSE expires_at_ms END AS expires_at_ms FROM live")
def kv_rename(spark, d):
    s = kv.alive(state(spark, d), NOW)
    return kv.rename(s, s.where(F.col("key").startswith("cust:2")).select("db", "key", F.concat(F.lit("moved:"), "key").alias("to")), NOW)


@register(f"WITH {STATE} SELECT db, key, value FROM live UNION ALL SELECT db, 'copy:' || key, value FROM live WHERE key LIKE 'cust:2%'")
def kv_copy(spark, d):
    s = kv.alive(state(spark, d), NOW)
    return kv.copy(s, s.where(F.col("key").startswith("cust:2")).select("db", "key", F.concat(F.lit("copy:"), "key").alias("to")), NOW).select("db", "key", "value")


@register(f"WITH {STATE} SELECT CASE WHEN key LIKE 'cust:3%' THEN 7 ELSE db END AS db, key, value, expires_at_ms FROM live")
def kv_move(spark, d):
    s = kv.alive(state(spark, d), NOW)
    return kv.move(s, s.where(F.col("key").startswith("cust:3")), 7, NOW)


@register(f"WITH {STATE} SELECT 'refused' AS batch, db, count(*) AS n FROM live GROUP BY db UNION ALL SELECT 'done', db, 2 * count(*) FROM live GROUP BY db")
def kv_msetnx(spark, d):
    """A batch in which one key exists leaves the state; one of new keys for all that are there doubles it."""
    s = kv.alive(state(spark, d), NOW)
    fresh = s.withColumn("key", F.concat(F.lit("new:"), "key"))
    refused, done = kv.set_all_if_none(s, s.limit(1).unionByName(fresh), NOW), kv.set_all_if_none(s, fresh, NOW)
    return kv.size(refused, NOW).select(F.lit("refused").alias("batch"), "db", "n").unionByName(kv.size(done, NOW).select(F.lit("done").alias("batch"), "db", "n"))


@register(f"WITH {STATE}, r AS (SELECT db, key, sum(strlen(key) + strlen(value) + 56) OVER (PARTITION BY db ORDER BY (CAST(split_part(key, ':', 2) AS BIGINT) * 37 % 1000) DESC, key ROWS UNBOUNDED PRECEDING) AS used FROM live) SELECT db, key FROM r WHERE used <= 5000")
def kv_lru(spark, d):
    s = kv.alive(state(spark, d), NOW)
    return kv.evict(s, s.select("db", "key", (F.split("key", ":")[1].cast("long") * 37 % 1000).alias("last_access_ms")), 5000).select("db", "key")


@register(f"WITH {STATE} SELECT db, key, CAST(strlen(key) + strlen(value) + 56 AS BIGINT) AS bytes, CASE WHEN try_cast(value AS BIGINT) IS NOT NULL THEN 'int' WHEN strlen(value) <= 44 THEN 'embstr' ELSE 'raw' END AS encoding FROM live")
def kv_memory_usage(spark, d):
    return kv.memory_usage(state(spark, d), NOW)


@register(f"WITH {STATE} SELECT db, key, value, expires_at_ms FROM live")
def kv_log_rewrite(spark, d):
    from orrery.sources.files import compact

    return kv.fold(compact(state(spark, d), NOW))


# The key exists from its first SET or SET NX on; from then on SET and SET XX replace the value, and SET NX doesn't.
@register("""WITH w AS (SELECT 0 AS db, 'o:' || o_custkey AS key, o_orderkey AS seq, o_orderkey % 4 AS c FROM orders),
f AS (SELECT db, key, min(seq) AS born FROM w WHERE c IN (0, 1) GROUP BY ALL)
SELECT db, key, 'v' || max(CASE WHEN seq = born OR c IN (0, 2) THEN seq END) AS value FROM w JOIN f USING (db, key) WHERE seq >= born GROUP BY ALL""")
def kv_set_options(spark, d):
    """SET, SET NX, SET XX and reads, mixed: replayed in order."""
    o = table(spark, d, "orders")
    kind = F.col("o_orderkey") % 4
    key, value = F.concat(F.lit("o:"), F.col("o_custkey").cast("string")), F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))
    args = F.when(kind == 1, F.array(key, value, F.lit("NX"))).when(kind == 2, F.array(key, value, F.lit("XX"))).otherwise(F.array(key, value))
    log = o.where(kind < 3).select(F.col("o_orderkey").alias("seq"), F.lit(0).cast("long").alias("ts_ms"), F.lit(0).alias("db"), F.lit("SET").alias("cmd"), args.alias("args"))
    return kv.fold(log).select("db", "key", "value")


@register(f"""WITH {STATE} SELECT db, key, 'string' AS type FROM state UNION SELECT 0, 'nation:' || c_nationkey, 'set' FROM customer""")
def kv_type(spark, d):
    c = table(spark, d, "customer")
    return kv.kind_of({"string": state(spark, d), "set": c.select(F.lit(0).alias("db"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("key"))})


# Every event is one command of a log that mixes them all, so what each answers depends on what came before it. The recursion runs each key's commands one by one.
MIXED = """c AS (SELECT event_id AS seq, CAST(user_id % 2 AS INTEGER) AS db, 'user:' || user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS ts, json_extract_string(props, '$.k') AS k, event_id % 13 AS c FROM events),
f AS (SELECT *, ['SET', 'SET', 'SET', 'SETNX', 'INCR', 'INCRBY', 'DECR', 'APPEND', 'GETSET', 'GETDEL', 'EXPIRE', 'PERSIST', 'DEL'][c + 1] AS cmd, row_number() OVER (PARTITION BY db, key ORDER BY seq) AS n FROM c)"""
STEP = """r(db, key, n, seq, cmd, value, ends, reply, error) AS (
  SELECT DISTINCT db, key, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, false FROM f
  UNION ALL
  SELECT db, key, n, seq, cmd,
    CASE WHEN c IN (0, 1) OR (c = 2 AND v IS NOT NULL) OR (c = 3 AND v IS NULL) OR c = 8 THEN k WHEN c IN (9, 12) THEN NULL WHEN c IN (4, 5, 6) THEN coalesce(CAST(total AS VARCHAR), v) WHEN c = 7 THEN coalesce(v, '') || k ELSE v END,
    CASE WHEN c = 1 THEN ts + 2000000000 WHEN c = 10 AND v IS NOT NULL THEN ts + CAST(k AS BIGINT) * 20000 * 1000 WHEN c IN (2, 3) AND (v IS NULL) = (c = 2) THEN e WHEN c IN (4, 5, 6) AND total IS NULL THEN e ELSE NULL END,
    CASE WHEN c IN (0, 1) OR (c = 2 AND v IS NOT NULL) THEN 'OK' WHEN c = 3 THEN CAST((v IS NULL)::INT AS VARCHAR) WHEN c IN (4, 5, 6) THEN CAST(total AS VARCHAR) WHEN c = 7 THEN CAST(strlen(coalesce(v, '') || k) AS VARCHAR) WHEN c IN (8, 9) THEN v WHEN c IN (10, 11, 12) THEN CAST((v IS NOT NULL)::INT AS VARCHAR) END,
    c IN (4, 5, 6) AND total IS NULL
  FROM (SELECT *, CASE WHEN v IS NULL OR try_cast(v AS BIGINT) IS NOT NULL THEN try_cast(coalesce(try_cast(v AS BIGINT), 0)::HUGEINT + CASE c WHEN 4 THEN 1 WHEN 6 THEN -1 ELSE CAST(k AS BIGINT) END AS BIGINT) END AS total
    FROM (SELECT f.*, CASE WHEN r.ends IS NULL OR f.ts <= r.ends THEN r.value END AS v, CASE WHEN f.ts <= r.ends THEN r.ends END AS e FROM r JOIN f ON f.db = r.db AND f.key = r.key AND f.n = r.n + 1)))"""


def mixed_log(spark, d):
    """A command for each event, of thirteen kinds in turn, most of which depend on what was there."""
    events = table(spark, d, "events")
    key, k = F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.get_json_object("props", "$.k")
    kinds = [("SET", k), ("SET", k, F.lit("EX"), F.lit("2000000")), ("SET", k, F.lit("XX")), ("SETNX", k), ("INCR",), ("INCRBY", k), ("DECR",), ("APPEND", k), ("GETSET", k), ("GETDEL",), ("EXPIRE", (k.cast("long") * 20000).cast("string")), ("PERSIST",), ("DEL",)]
    kind = F.get(F.array(*(F.struct(F.lit(c).alias("cmd"), F.array(key, *a).alias("args")) for c, *a in kinds)), (F.col("event_id") % 13).cast("int"))
    return events.select(F.col("event_id").alias("seq"), (F.unix_timestamp("ts") * 1000).alias("ts_ms"), (F.col("user_id") % 2).cast("int").alias("db"), kind["cmd"].alias("cmd"), kind["args"].alias("args"))


@register(f"WITH RECURSIVE {MIXED}, {STEP} SELECT seq, db, key, cmd, reply, error FROM r WHERE n > 0")
def kv_replies(spark, d):
    """What every command of the mixed log answers."""
    return kv.replies(mixed_log(spark, d)).withColumn("error", F.col("error").isNotNull())


@register(f"WITH RECURSIVE {MIXED}, {STEP} SELECT db, key, value, ends AS expires_at_ms FROM r WHERE value IS NOT NULL AND n = (SELECT max(n) FROM f WHERE f.db = r.db AND f.key = r.key)")
def kv_fold_mixed(spark, d):
    """What the mixed log leaves."""
    return kv.fold(mixed_log(spark, d))


@register("""WITH w AS (SELECT c_custkey, 'm:' || (c_custkey % 500) AS a, 'm:' || (c_custkey * 7 % 500) AS b, c_custkey % 3 AS kind FROM customer),
p AS (SELECT c_custkey AS seq, 0 AS part, a AS key, CASE kind WHEN 2 THEN NULL ELSE 'x' || c_custkey END AS value, CASE kind WHEN 1 THEN 1000 END AS ends FROM w UNION ALL SELECT c_custkey, 1, b, CASE kind WHEN 2 THEN NULL ELSE 'y' || c_custkey END, CASE kind WHEN 1 THEN 2000 END FROM w),
l AS (SELECT key, arg_max({'v': value, 'e': ends}, (seq, part)) AS s FROM p GROUP BY key)
SELECT 0 AS db, key, s.v AS value, CAST(s.e AS BIGINT) AS expires_at_ms FROM l WHERE s.v IS NOT NULL""")
def kv_many(spark, d):
    """MSET, MSETEX and MGETDEL of two keys each, in turn."""
    c = table(spark, d, "customer")
    n = F.col("c_custkey")
    a, b = F.concat(F.lit("m:"), (n % 500).cast("string")), F.concat(F.lit("m:"), (n * 7 % 500).cast("string"))
    x, y = F.concat(F.lit("x"), n.cast("string")), F.concat(F.lit("y"), n.cast("string"))
    args = F.when(n % 3 == 0, F.array(a, x, b, y)).when(n % 3 == 1, F.array(a, x, F.lit("1"), b, y, F.lit("2"))).otherwise(F.array(a, b))
    cmd = F.when(n % 3 == 0, "MSET").when(n % 3 == 1, "MSETEX").otherwise("MGETDEL")
    return kv.fold(c.select(n.alias("seq"), F.lit(0).cast("long").alias("ts_ms"), F.lit(0).alias("db"), cmd.alias("cmd"), args.alias("args")))
