"""Sessions, and how lineage is cut."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "orrery", master: str | None = None, **more: str) -> SparkSession:
    """A session with the library's defaults; more: further settings, with _ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared checkpoint folder, as a frame whose plan is new.

    Loops call it once a round: neither the lineage nor what the optimizer infers about columns grows, and a lost executor costs nothing that was done.
    The folder is the one the session names in spark.checkpoint.dir; only a local session that names none gets one of its own, as other machines couldn't read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    done = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files, and with cleanCheckpoints the checkpoints, that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
