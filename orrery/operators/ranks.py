"""Running sums and ranks within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import settled


def running(rows: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over those of the same key up to and with each, in an order that leaves no ties but among equal rows.

    Rows are dealt by ranges of key and order, so that a key that holds most of them spreads over many tasks; each range adds up its own, the sums before a range are added as a join on
    (key, range), and no task sorts more than a range.
    """
    part = f"__{name}_part"
    dealt = settled(rows.withColumn(f"__{name}", amount).repartitionByRange(*map(F.col, keys), *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(*keys, part).agg(F.sum(f"__{name}").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(part).alias("__of"), before.alias("__before"))
    same = [dealt[k].eqNullSafe(offsets[f"__{k}"]) for k in keys] + [dealt[part] == offsets["__of"]]
    inside = F.sum(f"__{name}").over(Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(offsets, same).withColumn(name, F.col("__before") + inside).select(*rows.columns, name)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place within the key, from 0."""
    return running(rows, keys, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)
