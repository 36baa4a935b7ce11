"""Lists, hashes, sets and sorted sets, in long form.

lists(db, key, pos, value), pos from 0; hashes(db, key, field, value); sets(db, key, member); zsets(db, key, member, score). Keys group the rows; no operator
gathers a key's rows in one value, and places and ranks are counted range by range, so a key may be of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import slice_bounds
from orrery.operators.ranks import ranked, running

KEY = ("db", "key")
#: Places of a key that a row is given at once.
MAX_PLACES = 1000


# -- lists ----------------------------------------------------------------------------------------------------------------------


def lists_from_pushes(log: DataFrame) -> DataFrame:
    """lists after pushes (seq, db, cmd, args): RPUSH appends its values in order, LPUSH puts each in front in turn."""
    at = F.posexplode(F.slice("args", 2, 1 << 30)).alias("i", "value")
    rows = log.where(F.col("cmd").isin("LPUSH", "RPUSH") & (F.size("args") > 1)).select("seq", "db", F.col("args")[0].alias("key"), "cmd", at)
    rows = rows.withColumn("side", F.when(F.col("cmd") == "LPUSH", -1).otherwise(1))
    rows = rows.select("db", "key", "side", (F.col("seq") * F.col("side")).alias("first"), (F.col("i") * F.col("side")).alias("then"), "value")
    return ranked(rows, list(KEY), [F.col("side"), F.col("first"), F.col("then")], "pos").select("db", "key", "pos", "value")


def list_length(lists: DataFrame) -> DataFrame:
    return lists.groupBy(*KEY).agg(F.count("*").alias("n"))


def _sized(lists: DataFrame) -> DataFrame:
    return lists.join(list_length(lists), list(KEY))


def list_index(lists: DataFrame, i: int) -> DataFrame:
    """(db, key, value): the value at a place, negative from the end, for the keys that have one."""
    if i >= 0:
        return lists.where(F.col("pos") == i).select(*KEY, "value")
    return _sized(lists).where(F.col("pos") == F.col("n") + i).select(*KEY, "value")


def list_range(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """(db, key, pos, value): an inclusive range, negative from the end, with places from the range's start."""
    first, last = slice_bounds(start, stop, F.col("n"))
    return _sized(lists).where(F.col("pos").between(first, last)).select(*KEY, (F.col("pos") - first).cast("long").alias("pos"), "value")


def list_pop(lists: DataFrame, n: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """What popping n from one end returns (db, key, rank, value), and the lists after it."""
    sized = _sized(lists)
    rank = F.col("pos") if left else F.col("n") - 1 - F.col("pos")
    popped = sized.where(rank < n).select(*KEY, rank.cast("long").alias("rank"), "value")
    kept = sized.where(rank >= n).select(*KEY, (F.col("pos") - (n if left else 0)).cast("long").alias("pos"), "value")
    return popped, kept


def list_set(lists: DataFrame, i: int, value: str) -> DataFrame:
    """lists with the value at a place replaced, where there is such a place."""
    place = F.lit(i) if i >= 0 else F.col("n") + i
    return _sized(lists).select(*KEY, "pos", F.when(F.col("pos") == place, F.lit(value)).otherwise(F.col("value")).alias("value"))


def list_remove(lists: DataFrame, value: str, count: int = 0) -> DataFrame:
    """lists without equal values: all for 0, the first or last |count| otherwise. Up to MAX_PLACES places to remove are sent to a key's rows; beyond, places are counted anew."""
    match = F.col("value").eqNullSafe(F.lit(value))
    if count == 0:
        kept = lists.where(~match)
    elif abs(count) <= MAX_PLACES:
        order = Window.partitionBy(*KEY).orderBy("pos" if count > 0 else F.desc("pos"))
        hits = lists.where(match).select(*KEY, "pos").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= abs(count))
        placed = lists.join(hits.groupBy(*KEY).agg(F.collect_list("pos").alias("gone")), list(KEY), "left")
        left = placed.where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("pos")))
        before = F.coalesce(F.size(F.filter("gone", lambda p: p < F.col("pos"))), F.lit(0))
        return left.select(*KEY, (F.col("pos") - F.when(F.col("gone").isNull(), 0).otherwise(before)).cast("long").alias("pos"), "value")
    else:
        seen = running(lists, list(KEY), [F.col("pos") if count > 0 else F.desc("pos")], match.cast("long"), "seen")
        kept = seen.where(~(match & (F.col("seen") <= abs(count))))
    return ranked(kept.select(*KEY, F.col("pos").alias("old"), "value"), list(KEY), [F.col("old")], "pos").select(*KEY, "pos", "value")


# -- hashes ---------------------------------------------------------------------------------------------------------------------


def hash_set(hashes: DataFrame, writes: DataFrame) -> DataFrame:
    """hashes after writes (seq, db, key, field, value); a field's last write wins."""
    last = writes.groupBy(*KEY, "field").agg(F.max_by("value", "seq").alias("value"))
    return hashes.join(last.select(*KEY, "field"), [*KEY, "field"], "left_anti").unionByName(last)


def hash_get(hashes: DataFrame, asked: DataFrame) -> DataFrame:
    """(pos, db, key, field, value) for each asked (pos, db, key, field), null where there is none."""
    return asked.join(hashes, [*KEY, "field"], "left").select("pos", *KEY, "field", "value")


def hash_delete(hashes: DataFrame, fields: DataFrame) -> DataFrame:
    return hashes.join(fields.select(*KEY, "field").distinct(), [*KEY, "field"], "left_anti")


def hash_length(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy(*KEY).agg(F.count("*").alias("n"))


def hash_increment(hashes: DataFrame, steps: DataFrame) -> DataFrame:
    """hashes after increments (db, key, field, delta); a missing field counts from 0, one that isn't a whole number stays as it is."""
    total = steps.groupBy(*KEY, "field").agg(F.sum("delta").alias("delta"))
    both = hashes.join(total, [*KEY, "field"], "full")
    number = F.when(F.col("value").isNull(), F.lit(0).cast("long")).otherwise(F.col("value").try_cast("long"))
    return both.select(*KEY, "field", F.when(F.col("delta").isNull() | number.isNull(), F.col("value")).otherwise(F.try_add(number, F.col("delta")).cast("string")).alias("value"))


# -- sets -----------------------------------------------------------------------------------------------------------------------


def set_add(sets: DataFrame, new: DataFrame) -> DataFrame:
    return sets.select(*KEY, "member").unionByName(new.select(*KEY, "member")).distinct()


def set_remove(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone.select(*KEY, "member").distinct(), [*KEY, "member"], "left_anti")


def set_size(sets: DataFrame) -> DataFrame:
    return sets.groupBy(*KEY).agg(F.count("*").alias("n"))


def _members(sets: DataFrame, db: int, key: str) -> DataFrame:
    return sets.where((F.col("db") == db) & (F.col("key") == key)).select("member")


def set_union(sets: DataFrame, db: int, keys: list[str]) -> DataFrame:
    return sets.where((F.col("db") == db) & F.col("key").isin(*keys)).select("member").distinct()


def set_intersection(sets: DataFrame, db: int, keys: list[str]) -> DataFrame:
    """Members of all keys; nothing if one is missing."""
    wanted = list(dict.fromkeys(keys))
    return sets.where((F.col("db") == db) & F.col("key").isin(*wanted)).select("key", "member").distinct().groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("member")


def set_difference(sets: DataFrame, db: int, keys: list[str]) -> DataFrame:
    """Members of the first key and of none of the others."""
    first = _members(sets, db, keys[0]).distinct()
    return reduce(lambda left, k: left.join(_members(sets, db, k), "member", "left_anti"), keys[1:], first)


# -- sorted sets ----------------------------------------------------------------------------------------------------------------


def zset_add(zsets: DataFrame, writes: DataFrame) -> DataFrame:
    """zsets after writes (seq, db, key, score as text, member); a member's last score wins, and a score that isn't a number is skipped."""
    last = writes.withColumn("score", F.col("score").try_cast("double")).where("score IS NOT NULL").groupBy(*KEY, "member").agg(F.max_by("score", "seq").alias("score"))
    return zsets.join(last.select(*KEY, "member"), [*KEY, "member"], "left_anti").unionByName(last)


def zset_remove(zsets: DataFrame, gone: DataFrame) -> DataFrame:
    return zsets.join(gone.select(*KEY, "member").distinct(), [*KEY, "member"], "left_anti")


def zset_rank(zsets: DataFrame) -> DataFrame:
    """(db, key, member, score, rank): rank from 0 by score, then member."""
    return ranked(zsets.select(*KEY, "member", "score"), list(KEY), [F.col("score"), F.col("member")])


def zset_range(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    """(db, key, rank, member, score): an inclusive range of ranks, negative from the end. A range counted from one end keeps only that many rows a key while sorting."""
    order, back = Window.partitionBy(*KEY).orderBy("score", "member"), Window.partitionBy(*KEY).orderBy(F.desc("score"), F.desc("member"))
    if 0 <= start <= stop:
        top = zsets.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= stop + 1)
        return top.where(F.col("rank") > start).select(*KEY, (F.col("rank") - 1).cast("long").alias("rank"), "member", "score")
    if start <= stop < 0:
        sized = zsets.join(zsets.groupBy(*KEY).agg(F.count("*").alias("n")), list(KEY))
        top = sized.withColumn("last", F.row_number().over(back)).where(F.col("last").between(-stop, -start))
        return top.select(*KEY, (F.col("n") - F.col("last")).cast("long").alias("rank"), "member", "score")
    first, last = slice_bounds(start, stop, F.col("n"))
    sized = zset_rank(zsets).join(zsets.groupBy(*KEY).agg(F.count("*").alias("n")), list(KEY))
    return sized.where(F.col("rank").between(first, last)).select(*KEY, "rank", "member", "score")


def zset_increment(zsets: DataFrame, steps: DataFrame) -> DataFrame:
    """zsets after increments (db, key, member, delta); a missing member counts from 0."""
    return zsets.select(*KEY, "member", "score").unionByName(steps.select(*KEY, "member", F.col("delta").alias("score"))).groupBy(*KEY, "member").agg(F.sum("score").alias("score"))


def zset_count(zsets: DataFrame, least: float, most: float) -> DataFrame:
    """(db, key, n): members with a score in an inclusive range, 0 where there are none."""
    return zsets.groupBy(*KEY).agg(F.count_if(F.col("score").between(least, most)).alias("n"))
