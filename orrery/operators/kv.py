"""Key-value operators: state is folded from a log, and read.

log: (seq, ts_ms, db, cmd, args). state: (db, key, value, expires_at_ms). Every read takes the clock as now_ms.

State and replies come from one fold: commands are dealt by key, sorted by Spark, which spills, and read one by one; what is held is one key's value, however many commands it
has. For the state alone, only commands from the last one that sets a key's value outright are read; this one is found by a sum with partial sums on the map side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import glob_match, live
from orrery.operators.ranks import running

#: Commands that set or delete a value whatever it was, and those that depend on it, by themselves or through a flush. Fixed values.
OUTRIGHT = ("SET", "SETEX", "PSETEX", "GETSET", "DEL", "GETDEL", "UNLINK")
DEPENDENT = ("SETNX", "INCR", "DECR", "INCRBY", "DECRBY", "INCRTTL", "APPEND", "EXPIRE", "PEXPIRE", "PERSIST", "GETEX")
MANY = ("MSET", "MSETEX", "MGETDEL")
READS = ("GET", "STRLEN")
FLUSHES = ("FLUSHDB", "FLUSHALL")
NOT_A_NUMBER, BAD_TIME = "value is not an integer or out of range", "invalid expire time"
whole_number = re.compile(r"[+-]?[0-9]{1,19}").fullmatch


def _number(text: str | None) -> int | None:
    """A text as a 64-bit integer, or None."""
    n = int(text) if text is not None and whole_number(text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


class Cell:
    """One key's value and expiry, and what each command does to them and replies. Appended pieces are joined only when the value is asked for."""

    def __init__(self) -> None:
        self.parts: list[str] | None = None
        self.expires: int | None = None

    @property
    def value(self) -> str | None:
        if self.parts is not None and len(self.parts) > 1:
            self.parts = ["".join(self.parts)]
        return None if self.parts is None else self.parts[0]

    def put(self, value: str | None, expires: int | None = None) -> None:
        self.parts, self.expires = None if value is None else [value], expires
        self.size = 0 if value is None else len(value.encode())

    def apply(self, cmd: str, args: list[str], now: int) -> tuple[str | None, str | None]:
        """Run a command; its reply, or its error. A command that fails changes nothing."""
        if self.parts is not None and self.expires is not None and now > self.expires:
            self.put(None)
        there, one = self.parts is not None, args[1] if len(args) > 1 else None
        if cmd == "SET":
            words = [(x or "").upper() for x in args[2:]]
            if ("NX" in words and there) or ("XX" in words and not there):
                return None, None
            after = lambda name: _number(args[words.index(name) + 3]) if name in words and words.index(name) + 3 < len(args) else None
            ex, px = after("EX"), after("PX")
            self.put(one, now + ex * 1000 if ex is not None else now + px if px is not None else None)
            return "OK", None
        if cmd in ("SETEX", "PSETEX"):
            time = _number(one)
            if time is None or time <= 0:
                return None, NOT_A_NUMBER if time is None else BAD_TIME
            self.put(args[2] if len(args) > 2 else None, now + time * (1000 if cmd == "SETEX" else 1))
            return "OK", None
        if cmd == "SETNX":
            if not there:
                self.put(one)
            return str(int(not there)), None
        if cmd in ("GET", "GETSET", "GETDEL"):
            old = self.value
            if cmd != "GET":
                self.put(one if cmd == "GETSET" else None)
            return old, None
        if cmd == "STRLEN":
            return str(self.size if there else 0), None
        if cmd in ("DEL", "UNLINK"):
            self.put(None)
            return str(int(there)), None
        if cmd in ("INCR", "DECR", "INCRBY", "DECRBY", "INCRTTL"):
            return self._count(cmd, args, now)
        if cmd == "APPEND":
            if there:
                self.parts.append(one or "")
                self.size += len((one or "").encode())
                self.expires = None
            else:
                self.put(one or "")
            return str(self.size), None
        if cmd in ("EXPIRE", "PEXPIRE"):
            time = _number(one)
            if time is None:
                return None, NOT_A_NUMBER
            if there:
                self.expires = now + time * (1000 if cmd == "EXPIRE" else 1)
            return str(int(there)), None
        if cmd == "PERSIST":
            self.expires = None
            return str(int(there)), None
        if cmd == "GETEX":
            option, time = (one or "").upper(), _number(args[2]) if len(args) > 2 else None
            if there and option in ("EX", "PX") and len(args) > 2:
                if time is None:
                    return None, NOT_A_NUMBER
                self.expires = now + time * (1000 if option == "EX" else 1)
            elif option == "PERSIST" and len(args) == 2:
                self.expires = None
            return self.value, None
        return None, f"unknown command {cmd}"

    def _count(self, cmd: str, args: list[str], now: int) -> tuple[str | None, str | None]:
        step, ends = 1, None
        if cmd in ("INCRBY", "DECRBY"):
            step = _number(args[1] if len(args) > 1 else None)
        elif cmd == "INCRTTL":
            words = [(x or "").upper() for x in args]
            at = words.index("EX", 1) if "EX" in words[1:] else len(args)
            time = _number(args[at + 1]) if at + 1 < len(args) else None
            ends = now + time * 1000 if time is not None else None
            steps = [_number(x) for k, x in enumerate(args) if k and k not in (at, at + 1)]
            step = (1 if steps[-1] is None else steps[-1]) if steps else 1
        old = 0 if self.parts is None else _number(self.value)
        if step is None or old is None:
            return None, NOT_A_NUMBER
        new = old + (-step if cmd in ("DECR", "DECRBY") else step)
        if not -(1 << 63) <= new < 1 << 63:
            return None, NOT_A_NUMBER
        self.put(str(new), ends)
        return str(new), None


def single_key(log: DataFrame) -> DataFrame:
    """The log with commands of many keys (MSET, DEL, UNLINK) cut to one row a key, in the order of the arguments."""
    step = lambda width, cmd, order: F.transform(F.sequence(F.lit(1), F.size("args") - width + 1, F.lit(width)), lambda i: F.struct(F.lit(cmd).alias("cmd"), F.array(*(F.get("args", i - 1 + k) for k in order)).alias("args")))
    each = lambda cmd: F.transform("args", lambda a: F.struct(F.lit(cmd).alias("cmd"), F.array(a).alias("args")))
    many = (
        F.when((F.col("cmd") == "MSET") & (F.size("args") > 1), step(2, "SET", (0, 1)))
        .when((F.col("cmd") == "MSETEX") & (F.size("args") > 2), step(3, "SETEX", (0, 2, 1)))
        .when(F.col("cmd").isin("DEL", "UNLINK") & (F.size("args") > 1), each("DEL"))
        .when(F.col("cmd") == "MGETDEL", each("GETDEL"))
        .otherwise(F.array(F.struct("cmd", "args")))
    )
    return log.select("seq", "ts_ms", "db", F.col("cmd").alias("of"), F.posexplode(many).alias("part", "c")).select("seq", "part", "ts_ms", "db", "of", "c.cmd", "c.args")


def _scan(rows: DataFrame, replies: bool) -> DataFrame:
    """The rows (db, key, epoch, seq, part, of, ts_ms, cmd, args) run in order: a row for each command with its reply, or for each key and epoch with what is left."""
    order = ["db", "key", "epoch", "seq", "part"]
    kinds = "seq long, part int, db int, key string, of string, reply string, error string" if replies else "db int, key string, value string, expires_at_ms long"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = Cell(), None
        for b in batches:
            out: list[tuple] = []
            for db, key, epoch, seq, part, of, ts, cmd, args in zip(*(b.column(c).to_pylist() for c in [*order, "of", "ts_ms", "cmd", "args"]), strict=True):
                if (db, key, epoch) != held:
                    if held is not None and not replies and cell.parts is not None:
                        out.append((held[0], held[1], cell.value, cell.expires))
                    cell, held = Cell(), (db, key, epoch)
                reply, error = cell.apply(cmd, args, ts)
                if replies:
                    out.append((seq, part, db, key, of, reply, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[] for _ in names], types, strict=True)], names=names)
        if held is not None and not replies and cell.parts is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((held[0], held[1], cell.value, cell.expires), types, strict=True)], names=names)

    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in kinds.split(", ")]
    one = rows.select("db", "key", "epoch", "seq", "part", "of", F.coalesce("ts_ms", F.lit(0)).cast("long").alias("ts_ms"), "cmd", "args")
    return one.repartition("db", "key").sortWithinPartitions(*order).mapInArrow(run, kinds)


def _commands(log: DataFrame, *more: str) -> DataFrame:
    rows = single_key(log.where(F.col("cmd").isin(*OUTRIGHT, *DEPENDENT, *MANY, *more)).select(F.col("seq").cast("long").alias("seq"), "ts_ms", F.col("db").cast("int").alias("db"), "cmd", "args"))
    return rows.withColumn("key", F.try_element_at("args", F.lit(1))).where("key IS NOT NULL")


def fold(log: DataFrame) -> DataFrame:
    """state after a log, with entries that expired but weren't removed. Unknown commands are skipped; a write that fails changes nothing."""
    rows = _commands(log)
    flush = log.where(F.col("cmd").isin(*FLUSHES)).groupBy(F.when(F.col("cmd") == "FLUSHDB", F.col("db")).alias("flushed")).agg(F.max("seq").alias("at"))
    # SET with NX or XX, and one with a time that fails, depend on what was there.
    optional = F.arrays_overlap(F.transform(F.slice("args", 3, 100), F.upper), F.array(F.lit("NX"), F.lit("XX")))
    plain = F.col("cmd").isin(*OUTRIGHT) & ~((F.col("cmd") == "SET") & optional) & ~(F.col("cmd").isin("SETEX", "PSETEX") & ~F.coalesce(F.get("args", F.lit(1)).try_cast("long") > 0, F.lit(False)))
    if not flush.isEmpty():
        # A row or two for each of the databases.
        barrier = F.broadcast(flush)
        rows = rows.join(barrier, (F.col("flushed").isNull() | (F.col("flushed") == F.col("db"))) & (F.col("seq") < F.col("at")), "left_anti")
    last = rows.groupBy("db", "key").agg(F.max(F.when(plain, F.struct("seq", "part"))).alias("from"))
    rest = rows.join(last, ["db", "key"]).where(F.col("from").isNull() | (F.struct("seq", "part") >= F.col("from")))
    return _scan(rest.withColumn("epoch", F.lit(0)), False)


#: Flushes that are sent along with the log; a log with more is cut to pieces by flush, which run one after the other.
MAX_FLUSHES = 10_000


def replies(log: DataFrame) -> DataFrame:
    """(seq, db, cmd, key, reply, error) of each command of strings: what it answers, as text (null where nothing is there, numbers in digits, a JSON list for MGETDEL). key: the first.

    A command that fails has an error instead and changes nothing. DEL of many keys answers how many there were. Flushes begin a new epoch of their database's keys.
    """
    flushes = log.where(F.col("cmd").isin(*FLUSHES)).select(F.col("seq").cast("long").alias("seq"), F.when(F.col("cmd") == "FLUSHDB", F.col("db").cast("int")).alias("db"))
    rows = _commands(log, *READS)
    count = flushes.count()
    if count > MAX_FLUSHES:
        raise ValueError(f"{count} flushes; cut the log at some, as nothing is left after one")
    at = F.array(*(F.struct(F.lit(r["seq"]).cast("long").alias("seq"), F.lit(r["db"]).cast("int").alias("db")) for r in flushes.collect())) if count else None  # MAX_FLUSHES rows at most
    epoch = F.size(F.filter(at, lambda f: (f["seq"] < F.col("seq")) & (f["db"].isNull() | (f["db"] == F.col("db"))))) if count else F.lit(0)
    each = _scan(rows.withColumn("epoch", epoch), True)
    each = each.withColumnRenamed("of", "cmd")
    many = F.col("cmd").isin("DEL", "UNLINK")
    whole = each.groupBy("seq", "db", "cmd").agg(
        F.min_by("key", "part").alias("key"), F.min_by(F.struct("reply", "error"), "part").alias("first"), F.sum(F.when(many, F.col("reply").try_cast("long"))).alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("cmd") == "MGETDEL", F.struct("part", "reply")))).alias("all"), F.max("error").alias("any_error"),
    )
    listed = F.to_json(F.transform("all", lambda x: x["reply"]), {"ignoreNullFields": "false"})
    reply = F.when(many, F.col("total").cast("string")).when(F.col("cmd") == "MGETDEL", listed).when(F.col("any_error").isNull(), F.col("first.reply"))
    return whole.select("seq", "db", "cmd", "key", reply.alias("reply"), F.col("any_error").alias("error"))


def alive(state: DataFrame, now_ms: int) -> DataFrame:
    return state.where(live(F.col("expires_at_ms"), now_ms))


def get_many(state: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """(pos, db, key, value) for each asked (pos, db, key), with null where there is none."""
    return asked.join(alive(state, now_ms).select("db", "key", "value"), ["db", "key"], "left").select("pos", "db", "key", "value")


def exists(state: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """(db, n): how many of the asked keys exist, repeated ones counted again."""
    return asked.join(alive(state, now_ms).select("db", "key", F.lit(1).alias("there")), ["db", "key"], "left").groupBy("db").agg(F.count("there").alias("n"))


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("db", "key").distinct(), ["db", "key"], "left_anti")


def ttl(state: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """(db, key, ttl, pttl): -2 without the key, -1 without expiry, else what is left in whole seconds and milliseconds."""
    left = F.col("expires_at_ms") - now_ms
    there = alive(state, now_ms).select("db", "key", "expires_at_ms", F.lit(1).alias("there"))
    pttl = F.when(F.col("there").isNull(), F.lit(-2)).when(F.col("expires_at_ms").isNull(), F.lit(-1)).otherwise(left)
    return asked.join(there, ["db", "key"], "left").select("db", "key", F.when(pttl < 0, pttl).otherwise(F.floor(pttl / 1000)).cast("long").alias("ttl"), pttl.cast("long").alias("pttl"))


def strlen(state: DataFrame, now_ms: int) -> DataFrame:
    return alive(state, now_ms).select("db", "key", F.octet_length("value").cast("long").alias("length"))


def size(state: DataFrame, now_ms: int) -> DataFrame:
    return alive(state, now_ms).groupBy("db").agg(F.count("*").alias("n"))


def keys(state: DataFrame, pattern: str, now_ms: int) -> DataFrame:
    return alive(state, now_ms).where(glob_match("key", pattern)).select("db", "key")


def scan(state: DataFrame, db: int, cursor: int, count: int, now_ms: int, pattern: str = "*", values: bool = False) -> DataFrame:
    """(key, value if wanted, next): the page of `count` keys in order from a cursor, and the next page's cursor, 0 at the end."""
    found = alive(state, now_ms).where((F.col("db") == db) & glob_match("key", pattern)).select("key", "value").orderBy("key").offset(cursor).limit(count + 1)
    n = F.count("*").over(Window.partitionBy())
    page = found.select("*", F.when(n > count, F.lit(cursor + count)).otherwise(F.lit(0)).cast("long").alias("next")).orderBy("key").limit(count)
    return page if values else page.drop("value")


def kind_of(stores: dict[str, DataFrame]) -> DataFrame:
    """(db, key, type): which stores hold a key; a key may be in several."""
    out = None
    for name, store in stores.items():
        rows = store.select("db", "key", F.lit(name).alias("type")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def old_values(log: DataFrame) -> DataFrame:
    """(seq, db, key, old): what each GETSET replaced, whatever commands came before it."""
    return replies(log).where("cmd = 'GETSET'").select("seq", "db", "key", F.col("reply").alias("old"))


def counters(log: DataFrame) -> DataFrame:
    """(seq, db, key, value): what each INCR, DECR, INCRBY and DECRBY returns, null where it fails, whatever commands came before it."""
    return replies(log).where(F.col("cmd").isin("INCR", "DECR", "INCRBY", "DECRBY")).select("seq", "db", "key", F.col("reply").cast("long").alias("value"))


def rename(state: DataFrame, moves: DataFrame, now_ms: int, only_new: bool = False) -> DataFrame:
    """state after renames (db, key, to), which drop the expiry; only_new leaves keys whose target exists. Each key is renamed once at most."""
    there = alive(state, now_ms)
    doing = moves.join(there.select("db", "key"), ["db", "key"], "left_semi")
    if only_new:
        doing = doing.join(there.select("db", F.col("key").alias("to")), ["db", "to"], "left_anti").select("db", "key", "to")
    doing = doing.groupBy("db", "to").agg(F.min("key").alias("key")).where("key <> to")
    moved = there.join(doing, ["db", "key"]).select("db", F.col("to").alias("key"), "value", F.lit(None).cast("long").alias("expires_at_ms"))
    gone = doing.select("db", F.explode(F.array("key", "to")).alias("key")).distinct()
    return state.join(gone, ["db", "key"], "left_anti").unionByName(moved)


def copy(state: DataFrame, pairs: DataFrame, now_ms: int, replace: bool = False) -> DataFrame:
    """state after copies (db, key, to), which have no expiry; without replace, targets that exist stay."""
    there = alive(state, now_ms)
    new = pairs.groupBy("db", "to").agg(F.min("key").alias("key")).join(there, ["db", "key"]).select("db", F.col("to").alias("key"), "value", F.lit(None).cast("long").alias("expires_at_ms"))
    if not replace:
        new = new.join(there.select("db", "key"), ["db", "key"], "left_anti")
    return state.join(new.select("db", "key"), ["db", "key"], "left_anti").unionByName(new)


def move(state: DataFrame, keys_: DataFrame, to_db: int, now_ms: int) -> DataFrame:
    """state after keys (db, key) moved to another database, with their expiry; a key that exists there stays where it was."""
    there = alive(state, now_ms)
    taken = there.where(F.col("db") == to_db).select("key")
    moving = there.join(keys_.select("db", "key").distinct(), ["db", "key"], "left_semi").where(F.col("db") != to_db).join(taken, "key", "left_anti")
    one = moving.groupBy("key").agg(F.min(F.struct("db", "value", "expires_at_ms")).alias("r")).select("key", "r.*")
    kept = state.join(one.select("db", "key"), ["db", "key"], "left_anti")
    kept = kept.join(one.select(F.lit(to_db).alias("db"), "key"), ["db", "key"], "left_anti")
    return kept.unionByName(one.select(F.lit(to_db).alias("db"), "key", "value", "expires_at_ms"))


def set_all_if_none(state: DataFrame, pairs: DataFrame, now_ms: int) -> DataFrame:
    """state after MSETNX of pairs (db, key, value): all are set, or none if any exists."""
    taken = alive(state, now_ms).join(pairs.select("db", "key"), ["db", "key"], "left_semi").limit(1).count()
    if taken:
        return state
    return state.join(pairs.select("db", "key"), ["db", "key"], "left_anti").unionByName(pairs.select("db", "key", "value", F.lit(None).cast("long").alias("expires_at_ms")))


def evict(state: DataFrame, accessed: DataFrame, budget: int, overhead: int = 56) -> DataFrame:
    """state cut to the keys last accessed (db, key, last_access_ms), whose sizes add up to the budget at most, database by database."""
    sized = state.join(accessed, ["db", "key"], "left").withColumn("bytes", F.octet_length("key") + F.octet_length("value") + overhead)
    return running(sized, ["db"], [F.desc_nulls_last("last_access_ms"), F.col("key")], F.col("bytes").cast("long"), "running").where(F.col("running") <= budget).select("db", "key", "value", "expires_at_ms")


def memory_usage(state: DataFrame, now_ms: int, overhead: int = 56) -> DataFrame:
    """(db, key, bytes, encoding)."""
    n = F.octet_length("value")
    return alive(state, now_ms).select("db", "key", (F.octet_length("key") + n + overhead).cast("long").alias("bytes"), F.when(F.col("value").try_cast("long").isNotNull(), "int").when(n <= 44, "embstr").otherwise("raw").alias("encoding"))
