"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Maps A-Z alone; str.lower() would also change letters outside ASCII.
LOWER_AZ = str.maketrans(ASCII_UPPER, ASCII_LOWER)
#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir; a local session that names none gets one of its own, which other machines couldn't read."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orrery-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder now and go on from the files, so that a lost executor costs no recomputation."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_plain(df: DataFrame) -> DataFrame:
    """As cut(), for short rows of a loop. What Spark infers about a frame's columns outlives checkpoint() and grows from round to round, until planning takes
    longer than the work; a frame made anew from the checkpointed rows carries none of it."""
    done = cut(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), df.sparkSession)


#: Partitions whose short rows go into one file.
FILE_PARTITIONS = 5


def cut_short(df: DataFrame) -> DataFrame:
    """As cut_plain(), with the rows of FILE_PARTITIONS partitions in a file, but two files a core at least. Each file costs requests, and in a local folder four processes that the
    executor starts to set modes. The stage that writes has as many tasks as files, so it is for frames whose last stage reads short rows alone."""
    spark = df.sparkSession
    return cut_plain(df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // FILE_PARTITIONS)))


#: Rows in the Arrow batches that Spark sends to Python: whole texts are long, and each task holds a batch or two.
ARROW_ROWS = 1000


def spread(df: DataFrame) -> DataFrame:
    """df over at least two tasks a core: a table of few files or row groups would keep most cores idle. Rows move only when the scan is that narrow; frames
    that are dealt by a shuffle already stay as they are, as asking for their partitions would run it. The session's Arrow batches get ARROW_ROWS rows at most."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, ARROW_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want // 2 else df.repartition(want)


def need(df: DataFrame, *names: str) -> None:
    """Raise a clear error where a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until it clashes with none of taken."""
    while name in taken:
        name = f"_{name}"
    return name


#: Rows of ids (16 bytes each) up to which a list of them is broadcast; a longer one is joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


def short(ids: DataFrame) -> DataFrame:
    """ids, written to the shared folder, and marked for broadcast if their count is within MAX_BROADCAST_IDS."""
    ids = cut_short(ids.distinct())
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text are in gone (doc_id, and copy: xxhash64 of the text). Null and repeated ids are told apart by their texts."""
    gone = short(gone.select(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_copy"]), "left_anti")


def hex_sha(column):
    """Lower-case hex SHA-256 of a string column's UTF-8 bytes."""
    return F.sha2(column, 256)


#: Words of a text's UTF-8 bytes: no byte of a longer character is one of the six white-space characters.
byte_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
AZ = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
#: Odd multipliers of mixing steps. Fixed values.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers, one for one."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def named_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names (two columns) of all words of some texts in a row, and where each text starts, with the end of the last."""
    lists = [byte_words(t) for t in texts]
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for x in lists for w in x), np.int64, int(starts[-1]))
    names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, index)), "<u8").reshape(-1, 2)
    return names[at], starts


#: What this worker keeps for later tasks, by its key: one thing at a time.
_KEPT: dict[Any, Any] = {}


def keep(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, kept in this worker until a task needs another thing, or none."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
        give_back()
    return _KEPT[key]


def let_go() -> None:
    """Free what keep() has kept."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()


def small_batches(batches, rows: int = 256, keeps: bool = False):
    """Arrow batches cut to a few hundred rows, so that a task's memory stays small. At the end, free memory goes back to the system: workers live on for other tasks.
    keeps: whether the task uses what keep() keeps; else that goes at the start, as the worker may have it from another operator."""
    if not keeps:
        let_go()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
