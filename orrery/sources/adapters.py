"""The model's tables, made from a star schema of orders, events and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an event does to its user's key.
EVENT_COMMANDS = {"signup": "SET", "click": "INCRBY", "purchase": "ZADD", "view": "SADD", "error": "DEL"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(key, type, name)."""
    spec = [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("order", "orders", "o_orderkey", "o_orderpriority")]
    return reduce(DataFrame.unionByName, (table(spark, sf_dir, t).select(_key(kind, k).alias("key"), F.lit(kind).alias("type"), F.col(n).alias("name")) for kind, t, k, n in spec))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, type, weight): from region down to part."""
    spec = [("nation", "region", "n_regionkey", "nation", "n_nationkey", "has_nation"), ("customer", "nation", "c_nationkey", "customer", "c_custkey", "has_customer"), ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "has_supplier"), ("orders", "customer", "o_custkey", "order", "o_orderkey", "placed")]
    one = [table(spark, sf_dir, t).select(_key(a, x).alias("src"), _key(b, y).alias("dst"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight")) for t, a, x, b, y, kind in spec]
    lines = table(spark, sf_dir, "lineitem").select(_key("order", "l_orderkey").alias("src"), _key("part", "l_partkey").alias("dst"), F.lit("contains").alias("type"), F.col("l_quantity").alias("weight"))
    return reduce(DataFrame.unionByName, [*one, lines])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors(key, id, label, vec)."""
    return table(spark, sf_dir, "embeddings").select(_key("vec", "vec_id").alias("key"), F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memories: a row for each event, with the vector of event_id modulo 500."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select(
        F.concat(F.lit("agent:"), F.col("user_id").cast("string")).alias("agent"), _key("mem", "event_id").alias("id"), "event_id", F.col("event_type").alias("type"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("text"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("importance"), F.unix_timestamp("ts").alias("created_at"), F.coalesce(k, F.lit(0)).alias("access_count"), F.lit(604800).cast("long").alias("halflife"), (F.col("event_id") % 500).alias("vec_id"),
    )
    return rows.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id").drop("vec_id")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """command_log(seq, ts_ms, db, cmd, args): what each event does to its user's key, in database user_id modulo 2."""
    events = table(spark, sf_dir, "events")
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    args = (
        F.when(F.col("event_type") == "purchase", F.array(key, F.col("value").cast("string"), F.concat(F.lit("item:"), k)))
        .when(F.col("event_type") == "view", F.array(key, F.concat(F.lit("page:"), k)))
        .when(F.col("event_type") == "error", F.array(key))
        .otherwise(F.array(key, k))
    )
    cmd = F.create_map(*(F.lit(x) for kv in EVENT_COMMANDS.items() for x in kv))[F.col("event_type")]
    return events.select(F.col("event_id").alias("seq"), (F.unix_timestamp("ts") * 1000).alias("ts_ms"), (F.col("user_id") % 2).cast("int").alias("db"), cmd.alias("cmd"), args.alias("args"))
