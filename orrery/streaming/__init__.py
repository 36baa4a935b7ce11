"""Publish and subscribe, log folding and windows over events, as batch frames or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.functions import glob_match_column
from orrery.operators import kv
from orrery.sources import files

#: Letters of a pattern's beginning that messages are dealt by.
LENGTH = 16


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(seq, channel, subscriber, payload): a delivery for each subscriber of a message's channel, by name or by pattern, once each.

    messages may be a stream; subscriptions (subscriber, channel, is_pattern) is a static table.
    """
    exact = subscriptions.where("NOT is_pattern").select("channel", "subscriber").distinct()
    by_name = messages.join(exact, "channel").select("seq", "channel", "subscriber", "payload")
    patterns = subscriptions.where("is_pattern").select(F.col("channel").alias("pattern"), "subscriber").distinct()
    # A pattern is tested only for channels that begin with the letters before its first * or ?: an equi-join on them, once for each length that there is (LENGTH at most).
    patterns = patterns.withColumn("begins", F.substring(F.regexp_extract("pattern", r"^([^*?]*)", 1), 1, LENGTH))
    lengths = [r[0] for r in patterns.select(F.length("begins")).distinct().collect()]  # LENGTH + 1 rows at most
    begins = F.explode(F.array_distinct(F.array(*(F.substring("channel", 1, n) if n else F.lit("") for n in lengths)))).alias("begins")
    near = messages.select("seq", "channel", "payload", begins) if lengths else messages.limit(0).select("seq", "channel", "payload", F.lit("").alias("begins"))
    by_pattern = near.join(patterns, "begins").where(glob_match_column(F.col("channel"), F.col("pattern"))).select("seq", "channel", "subscriber", "payload")
    if not lengths:
        return by_name if messages.isStreaming else by_name.distinct()
    both = by_name.unionByName(by_pattern)
    return both if messages.isStreaming else both.distinct()


def receivers(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(seq, channel, receivers): what PUBLISH returns for each message."""
    got = publish(messages, subscriptions).groupBy("seq").agg(F.count("*").alias("n"))
    return messages.join(got, "seq", "left").select("seq", "channel", F.coalesce("n", F.lit(0)).cast("long").alias("receivers"))


def fold_stream(log: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of commands to key-value state. Each micro-batch runs on the state before it and leaves a new one in a folder of its own number, so that a repeated batch writes
    the same again; folders before the last two are deleted. A batch costs what the state and the batch hold, however long the log was. seq must grow from batch to batch."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = [n for n in files._markers(spark, state_path, "state") if n < number]
        commands = rows.select("seq", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("db").cast("int").alias("db"), "cmd", "args")
        if before:
            commands = files.as_log(spark.read.parquet(f"{state_path}/state-{before[-1]}")).unionByName(commands)
        kv.fold(commands).write.mode("overwrite").parquet(f"{state_path}/state-{number}")
        for n in before[:-1]:
            files._delete(spark, f"{state_path}/state-{n}")

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_state(spark, state_path: str, now_ms: int) -> DataFrame:
    """The state that the last whole batch left, as of now."""
    found = files._markers(spark, state_path, "state")
    if not found:
        raise ValueError(f"no state in {state_path}")
    return kv.alive(spark.read.parquet(f"{state_path}/state-{found[-1]}"), now_ms)


def watched(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(db, key, changed): whether a watched key (db, key, seq of the snapshot) was written after it."""
    last = log.select("db", F.try_element_at("args", F.lit(1)).alias("key"), "seq").groupBy("db", "key").agg(F.max("seq").alias("last"))
    return snapshot.join(last, ["db", "key"], "left").select("db", "key", (F.coalesce("last", F.lit(-1)) > F.col("seq")).alias("changed"))


def command_counts(log: DataFrame) -> DataFrame:
    """(cmd, calls); for batches and streams."""
    return log.groupBy("cmd").agg(F.count("*").alias("calls"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows with a watermark; for batches and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions of users, parted by gaps."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
