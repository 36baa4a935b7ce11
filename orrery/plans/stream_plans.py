"""Publish and subscribe, watches, counters and windows, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery import streaming
from orrery.plans.registry import register
from orrery.sources.adapters import command_log, table

MESSAGES = "m AS (SELECT event_id AS seq, 'news.' || event_type || '.' || (user_id % 10) AS channel, CAST(value AS VARCHAR) AS payload FROM events)"
SUBS = "s AS (SELECT 'sub:' || i AS subscriber, 'news.' || CASE i % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END || '.' || (i % 10) AS channel FROM range(0, 40) t(i))"


def messages(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("news."), "event_type", F.lit("."), (F.col("user_id") % 10).cast("string")).alias("channel"), F.col("value").cast("string").alias("payload"))


def subscriptions(spark):
    kind = F.when(F.col("id") % 3 == 0, "click").when(F.col("id") % 3 == 1, "view").otherwise("error")
    return spark.range(40).select(F.concat(F.lit("sub:"), F.col("id").cast("string")).alias("subscriber"), F.concat(F.lit("news."), kind, F.lit("."), (F.col("id") % 10).cast("string")).alias("channel"), F.lit(False).alias("is_pattern"))


@register(f"WITH {MESSAGES}, {SUBS} SELECT seq, m.channel, count(subscriber) AS receivers FROM m LEFT JOIN s USING (channel) GROUP BY ALL")
def pubsub_publish(spark, d):
    return streaming.receivers(messages(spark, d), subscriptions(spark))


@register(f"WITH {MESSAGES} SELECT seq, channel, (CASE WHEN channel LIKE 'news.c%' THEN 1 ELSE 0 END + CASE WHEN channel LIKE 'news.%._' AND channel LIKE '%.3' THEN 1 ELSE 0 END)::BIGINT AS receivers FROM m")
def pubsub_psubscribe(spark, d):
    patterns = spark.createDataFrame([("a", "news.c*", True), ("b", "news.*.3", True)], "subscriber string, channel string, is_pattern boolean")
    return streaming.receivers(messages(spark, d), patterns)


@register("SELECT CAST(user_id % 2 AS INTEGER) AS db, 'user:' || user_id AS key, max(event_id) > 500 AS changed FROM events GROUP BY ALL")
def transaction_watch(spark, d):
    log = command_log(spark, d)
    return streaming.watched(log, log.select("db", F.col("args")[0].alias("key")).distinct().withColumn("seq", F.lit(500)))


@register("SELECT CASE event_type WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'INCRBY' WHEN 'purchase' THEN 'ZADD' WHEN 'view' THEN 'SADD' ELSE 'DEL' END AS cmd, count(*) AS calls FROM events GROUP BY ALL")
def command_stats(spark, d):
    return streaming.command_counts(command_log(spark, d))


@register("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    return streaming.windowed(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return streaming.sessions(table(spark, d, "events"), "12 hours").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("began"))
