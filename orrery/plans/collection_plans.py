"""List, hash, set and sorted-set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import collections as col
from orrery.plans.registry import register
from orrery.sources.adapters import command_log, table

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
LISTS = f"lists AS (SELECT 0 AS db, 'order:' || l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS pos, 'part:' || (l_partkey % 50) AS value FROM lineitem), sized AS (SELECT *, count(*) OVER (PARTITION BY db, key) AS n FROM lists)"


def lists(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))
    return table(spark, d, "lineitem").select(F.lit(0).alias("db"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.concat(F.lit("part:"), (F.col("l_partkey") % 50).cast("string")).alias("value"))


@register(f"WITH {LISTS} SELECT db, key, count(*) AS n FROM lists GROUP BY ALL")
def list_llen(spark, d):
    return col.list_length(lists(spark, d))


@register(f"WITH {LISTS} SELECT db, key, value FROM sized WHERE pos = n - 2")
def list_lindex(spark, d):
    return col.list_index(lists(spark, d), -2)


@register(f"WITH {LISTS} SELECT db, key, CAST(pos - 1 AS BIGINT) AS pos, value FROM sized WHERE pos BETWEEN 1 AND n - 2")
def list_lrange(spark, d):
    return col.list_range(lists(spark, d), 1, -2)


@register(f"WITH {LISTS} SELECT db, key, CAST(n - 1 - pos AS BIGINT) AS rank, value FROM sized WHERE n - 1 - pos < 2")
def list_rpop(spark, d):
    return col.list_pop(lists(spark, d), 2, left=False)[0]


@register(f"WITH {LISTS} SELECT db, key, CAST(pos - 1 AS BIGINT) AS pos, value FROM lists WHERE pos >= 1")
def list_lpop(spark, d):
    return col.list_pop(lists(spark, d))[1]


@register(f"WITH {LISTS} SELECT db, key, pos, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM sized")
def list_lset(spark, d):
    return col.list_set(lists(spark, d), -1, "last")


@register(f"""WITH {LISTS}, r AS (SELECT *, sum(CASE WHEN value = 'part:7' THEN 1 ELSE 0 END) OVER (PARTITION BY db, key ORDER BY pos DESC) AS seen FROM lists)
SELECT db, key, row_number() OVER (PARTITION BY db, key ORDER BY pos) - 1 AS pos, value FROM r WHERE NOT (value = 'part:7' AND seen <= 1)""")
def list_lrem(spark, d):
    return col.list_remove(lists(spark, d), "part:7", -1)


@register("""WITH w AS (SELECT event_id AS seq, CAST(user_id % 2 AS INTEGER) AS db, 'user:' || user_id AS key, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IN ('click', 'view')),
v AS (SELECT db, key, CASE WHEN event_type = 'click' THEN -1 ELSE 1 END AS side, seq, i, CASE i WHEN 0 THEN k ELSE 'x' END AS value FROM w, range(0, 2) t(i))
SELECT db, key, row_number() OVER (PARTITION BY db, key ORDER BY side, seq * side, i * side) - 1 AS pos, value FROM v""")
def list_push(spark, d):
    log = command_log(spark, d).where(F.col("cmd").isin("INCRBY", "SADD"))
    k = F.regexp_extract(F.col("args")[1], r"(\d+)$", 1)
    return col.lists_from_pushes(log.select("seq", "db", F.when(F.col("cmd") == "INCRBY", "LPUSH").otherwise("RPUSH").alias("cmd"), F.array(F.col("args")[0], k, F.lit("x")).alias("args")))


FIELDS = {"name": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey"}
HASHES = "hashes AS (" + " UNION ALL ".join(f"SELECT 0 AS db, 'cust:' || c_custkey AS key, '{f}' AS field, CAST({c} AS VARCHAR) AS value FROM customer" for f, c in FIELDS.items()) + ")"


def hashes(spark, d):
    c = table(spark, d, "customer")
    pairs = F.explode(F.create_map(*(x for f, v in FIELDS.items() for x in (F.lit(f), F.col(v).cast("string"))))).alias("field", "value")
    return c.select(F.lit(0).alias("db"), F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), pairs)


@register(f"WITH {HASHES} SELECT * FROM hashes")
def hash_hgetall(spark, d):
    return hashes(spark, d)


@register(f"WITH {HASHES}, a AS (SELECT i AS pos, 0 AS db, 'cust:' || (i * 3) AS key, CASE WHEN i % 2 = 0 THEN 'segment' ELSE 'missing' END AS field FROM range(0, 100) t(i)) SELECT pos, db, key, field, value FROM a LEFT JOIN hashes USING (db, key, field)")
def hash_hmget(spark, d):
    asked = spark.range(100).select(F.col("id").alias("pos"), F.lit(0).alias("db"), F.concat(F.lit("cust:"), (F.col("id") * 3).cast("string")).alias("key"), F.when(F.col("id") % 2 == 0, "segment").otherwise("missing").alias("field"))
    return col.hash_get(hashes(spark, d), asked)


@register(f"WITH {HASHES} SELECT db, key, count(*) AS n FROM hashes WHERE NOT (field = 'segment' AND key LIKE 'cust:2%') GROUP BY ALL")
def hash_hdel_hlen(spark, d):
    h = hashes(spark, d)
    return col.hash_length(col.hash_delete(h, h.where((F.col("field") == "segment") & F.col("key").startswith("cust:2"))))


@register("""WITH h AS (SELECT 0 AS db, 'cust:' || c_custkey AS key, c_custkey, CAST(c_nationkey AS VARCHAR) AS nation FROM customer), o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)
SELECT db, key, 'nation' AS field, CAST(CAST(nation AS BIGINT) + coalesce(n, 0) AS VARCHAR) AS value FROM h LEFT JOIN o ON o_custkey = c_custkey UNION ALL SELECT 0, 'cust:' || o_custkey, 'orders', CAST(n AS VARCHAR) FROM o""")
def hash_hincrby(spark, d):
    o = table(spark, d, "orders").select(F.lit(0).alias("db"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.explode(F.array(F.lit("nation"), F.lit("orders"))).alias("field"), F.lit(1).cast("long").alias("delta"))
    return col.hash_increment(hashes(spark, d).where("field = 'nation'"), o)


@register("WITH w AS (SELECT 0 AS db, 'cust:' || o_custkey AS key, o_orderpriority AS field, o_orderstatus AS value, o_orderkey AS seq FROM orders) SELECT db, key, field, arg_max(value, seq) AS value FROM w GROUP BY ALL")
def hash_hset(spark, d):
    w = table(spark, d, "orders").select(F.lit(0).alias("db"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))
    return col.hash_set(spark.createDataFrame([], "db int, key string, field string, value string"), w)


SETS = "sets AS (SELECT DISTINCT 0 AS db, 'supp:' || l_suppkey AS key, 'part:' || l_partkey AS member FROM lineitem)"


def sets(spark, d):
    return table(spark, d, "lineitem").select(F.lit(0).alias("db"), F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string")).alias("key"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("member")).distinct()


@register(f"WITH {SETS} SELECT db, key, count(*) AS n FROM sets GROUP BY ALL")
def set_scard(spark, d):
    return col.set_size(sets(spark, d))


@register(f"WITH {SETS} SELECT DISTINCT db, key, member FROM (SELECT * FROM sets WHERE member NOT LIKE 'part:1%' UNION ALL SELECT 0, 'supp:0', 'extra')")
def set_sadd_srem(spark, d):
    s = sets(spark, d)
    return col.set_add(col.set_remove(s, s.where(F.col("member").startswith("part:1"))), spark.createDataFrame([(0, "supp:0", "extra"), (0, "supp:0", "extra")], "db int, key string, member string"))


@register(f"WITH {SETS} SELECT member FROM sets WHERE key = 'supp:3'")
def set_smembers(spark, d):
    return sets(spark, d).where("key = 'supp:3'").select("member")


@register(f"WITH {SETS} SELECT DISTINCT member FROM sets WHERE key IN ('supp:1', 'supp:2', 'supp:3')")
def set_sunion(spark, d):
    return col.set_union(sets(spark, d), 0, ["supp:1", "supp:2", "supp:3"])


@register(f"WITH {SETS} SELECT member FROM sets WHERE key = 'supp:1' INTERSECT SELECT member FROM sets WHERE key = 'supp:2'")
def set_sinter(spark, d):
    return col.set_intersection(sets(spark, d), 0, ["supp:1", "supp:2"])


@register(f"WITH {SETS} SELECT member FROM sets WHERE key = 'supp:1' EXCEPT SELECT member FROM sets WHERE key IN ('supp:2', 'supp:9')")
def set_sdiff(spark, d):
    return col.set_difference(sets(spark, d), 0, ["supp:1", "supp:2", "supp:9"])


ZSETS = "zsets AS (SELECT 0 AS db, 'cust:' || o_custkey AS key, 'order:' || o_orderkey AS member, o_totalprice AS score FROM orders), ranked AS (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY db, key) AS n FROM zsets)"


def zsets(spark, d):
    return table(spark, d, "orders").select(F.lit(0).alias("db"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("member"), F.col("o_totalprice").alias("score"))


@register(f"WITH {ZSETS} SELECT db, key, member, score, rank FROM ranked")
def zset_zrank(spark, d):
    return col.zset_rank(zsets(spark, d))


@register(f"WITH {ZSETS} SELECT db, key, rank, member, printf('%.6f', score) AS score FROM ranked WHERE rank BETWEEN n - 3 AND n - 1")
def zset_zrange(spark, d):
    return col.zset_range(zsets(spark, d), -3, -1).withColumn("score", F.format_string("%.6f", "score"))


@register(f"WITH {ZSETS} SELECT db, key, rank, member, score FROM ranked WHERE rank < 2")
def zset_zrange_first(spark, d):
    return col.zset_range(zsets(spark, d), 0, 1)


@register(f"WITH {ZSETS} SELECT db, key, count(*) FILTER (score BETWEEN 50000 AND 150000) AS n FROM zsets GROUP BY ALL")
def zset_zcount(spark, d):
    return col.zset_count(zsets(spark, d), 50000, 150000)


@register("WITH e AS (SELECT CAST(user_id % 2 AS INTEGER) AS db, 'user:' || user_id AS key, 'item:' || json_extract_string(props, '$.k') AS member, value FROM events WHERE event_type = 'purchase') SELECT db, key, member, round(sum(value), 4) AS score FROM e GROUP BY ALL")
def zset_zincrby(spark, d):
    log = command_log(spark, d).where("cmd = 'ZADD'").select("db", F.col("args")[0].alias("key"), F.col("args")[2].alias("member"), F.col("args")[1].cast("double").alias("delta"))
    return col.zset_increment(spark.createDataFrame([], "db int, key string, member string, score double"), log).withColumn("score", F.round("score", 4))


@register("WITH e AS (SELECT event_id, CAST(user_id % 2 AS INTEGER) AS db, 'user:' || user_id AS key, 'item:' || json_extract_string(props, '$.k') AS member, value FROM events WHERE event_type = 'purchase') SELECT db, key, member, arg_max(value, event_id) AS score FROM e GROUP BY ALL HAVING member NOT LIKE 'item:1%'")
def zset_zadd_zrem(spark, d):
    log = command_log(spark, d).where("cmd = 'ZADD'").select("seq", "db", F.col("args")[0].alias("key"), F.col("args")[1].alias("score"), F.col("args")[2].alias("member"))
    z = col.zset_add(spark.createDataFrame([], "db int, key string, member string, score double"), log)
    return col.zset_remove(z, z.where(F.col("member").startswith("item:1")))
