"""Snapshots, the append-only log, and its compaction, as Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import live, normalize
from orrery.operators import kv


def _folder(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _markers(spark: SparkSession, path: str, name: str = "tables") -> list[int]:
    """The numbers of the whole folders name-<number> below path, in whatever store it is."""
    store, there = _folder(spark, path)
    if not store.exists(there):
        return []
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in store.listStatus(there)]
    return sorted(int(p.getName().rpartition("-")[2]) for p in found if re.fullmatch(rf"{name}-[0-9]+", p.getName()) and store.exists(of(p, "_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    store, there = _folder(spark, path)
    store.delete(there, True)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table into a new folder below path. A marker that names the folder and its tables is added last, so a save that breaks off leaves the snapshot before it as it was; what the newest
    marker doesn't name is deleted after it."""
    spark = next(iter(tables.values())).sparkSession
    old = _markers(spark, path)
    number = max(old, default=0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/data-{number}/{name}")
    spark.createDataFrame([(n,) for n in sorted(tables)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tables-{number}")
    for n in old:
        _delete(spark, f"{path}/tables-{n}")
        _delete(spark, f"{path}/data-{n}")


def load_snapshot(spark: SparkSession, path: str, now_ms: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot; entries that expired by now_ms are left out."""
    found = _markers(spark, path)
    if not found:
        raise ValueError(f"no snapshot in {path}")
    number = max(found)
    tables = {r["name"]: spark.read.parquet(f"{path}/data-{number}/{r['name']}") for r in spark.read.parquet(f"{path}/tables-{number}").collect()}
    if now_ms is not None:
        tables = {n: df.where(live(F.col("expires_at_ms"), now_ms)) if "expires_at_ms" in df.columns else df for n, df in tables.items()}
    return tables


def save_vectors(vectors: DataFrame, path: str) -> None:
    """vectors(key, field, vec) as a file of its own: unit vectors of single floats with their dimension, a folder for each field, sorted by key within each part so that a reader can skip."""
    unit = F.transform(normalize(F.col("vec")), lambda x: x.cast("float"))
    vectors.where("vec IS NOT NULL").select("key", "field", F.size("vec").alias("dim"), unit.alias("vec")).sortWithinPartitions("field", "key").write.mode("overwrite").partitionBy("field").parquet(path)


def load_vectors(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """vectors(key, field, vec) of such a file, of one field only if given; vectors that don't have the dimension they were saved with raise an error."""
    read = spark.read.parquet(path)
    read = read if field is None else read.where(F.col("field") == field)
    whole = F.when(F.size("vec") == F.col("dim"), F.transform("vec", lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("array<double>"))
    return read.select("key", F.col("field").cast("string").alias("field"), whole.alias("vec"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def replay_log(spark: SparkSession, path: str, now_ms: int) -> DataFrame:
    """Key-value state after all of a log, as of now."""
    return kv.alive(kv.fold(spark.read.parquet(path)), now_ms)


def as_log(state: DataFrame) -> DataFrame:
    """A log that leaves a state, with each key's time, before all commands of another log."""
    args = F.when(F.col("expires_at_ms").isNull(), F.array("key", "value")).otherwise(F.array(F.col("key"), F.col("value"), F.lit("PX"), F.col("expires_at_ms").cast("string")))
    return state.select(F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("ts_ms"), "db", F.lit("SET").alias("cmd"), args.alias("args"))


def rewrite(tables: dict[str, DataFrame], now_ms: int) -> DataFrame:
    """The shortest log (seq, ts_ms, db, cmd, args) that gives the strings, lists, hashes, sets, sorted sets and graph in tables (kv, lists, hashes, sets, zsets, nodes, edges; any may be missing).

    A list is pushed value by value in order; everything else in one command for each entry, in any order, nodes before edges.
    """
    command = lambda df, seq, cmd, *args: df.select(seq.cast("long").alias("seq"), F.lit(now_ms).cast("long").alias("ts_ms"), (F.col("db") if "db" in df.columns else F.lit(0)).cast("int").alias("db"), F.lit(cmd).alias("cmd"), F.array(*(F.col(a) if isinstance(a, str) else a for a in args)).alias("args"))
    some = F.monotonically_increasing_id()
    late = F.lit(1 << 61) + some
    made = {
        "kv": lambda t: compact(t, now_ms),
        "lists": lambda t: command(t, F.col("pos"), "RPUSH", "key", "value"),
        "hashes": lambda t: command(t, some, "HSET", "key", "field", "value"),
        "sets": lambda t: command(t, some, "SADD", "key", "member"),
        "zsets": lambda t: command(t, some, "ZADD", "key", F.col("score").cast("string"), "member"),
        "nodes": lambda t: command(t, some, "GRAPH.UPSERT_NODE", "key", "type", F.to_json("props") if "props" in t.columns else F.lit("{}")),
        "edges": lambda t: command(t, late, "GRAPH.ADDEDGE", "src", "dst", "type", F.col("weight").cast("string")),
    }
    out = None
    for name, make in made.items():
        if name in tables:
            rows = make(tables[name]).select("seq", "ts_ms", "db", "cmd", "args")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"none of {sorted(made)}")
    return out


def compact(state: DataFrame, now_ms: int) -> DataFrame:
    """The shortest log that gives a state: a SET for each live key, with what is left of its time."""
    left = (F.col("expires_at_ms") - now_ms).cast("string")
    args = F.when(F.col("expires_at_ms").isNull(), F.array("key", "value")).otherwise(F.array(F.col("key"), F.col("value"), F.lit("PX"), left))
    # Each row has a key of its own, so their order doesn't matter and need not be a running number.
    return kv.alive(state, now_ms).select(F.monotonically_increasing_id().alias("seq"), F.lit(now_ms).cast("long").alias("ts_ms"), "db", F.lit("SET").alias("cmd"), args.alias("args"))
