"""Substring dedup by recompression.

A window is `width` consecutive words. Each word covered by a window whose words also start in a document with a smaller doc_id goes.

Words are named by 128-bit hashes, alike in all documents, and then rounds name runs of a symbol and pairs of neighbouring symbols
(a left symbol before a right one, sides drawn by hash) in the same way: a name is a hash of what it stands for, so it is global
without being looked up. Inside equal substrings the same symbols arise; only near their ends does what lies outside matter. For
each symbol the span of words that settles it is kept. A window that holds this span holds the symbol, wherever the window occurs.
So each window elects, from the highest level that settles a symbol within it, the one with the smallest hash, and equal windows
elect equal symbols: a window's twins are all found under its symbol's settled span, its key. Some twenty windows in a row share one.

1. Each row (key, document, range of windows, hash of all words in the range) goes to its key. Equal range hashes mean that all windows
   of the range repeat: those in documents after the first are marked whole.
2. Where one key has unlike ranges (at the ends of a repeat, and around edits), the first document of each unlike range sends its
   windows one by one as 128-bit hashes, and windows after the first document's are marked.
3. Each document's marked windows meet its text, which drops the covered words.

Marks are decided by 128-bit hashes of the words themselves, so a shared symbol alone removes nothing. A key's rows are one or a few
for each document and are sorted by Spark, which spills; no group is gathered in Python. Texts are shuffled once, compressed,
and once more for documents with marks; nothing is broadcast or collected.

Defined cases: null and empty texts have no words; a null doc_id is neither smaller than others nor has smaller ones, so its row stays
whole; repeated rows are treated each on its own (equal ids never remove each other's words); other columns are kept by dedup() and
ignored by its digests, and a clash with its output names raises an error; an empty table gives an empty result; widths are 1 to RANGE - 1 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import byte_words, cut, mixed, named_words, need, small_batches, spread, utf8

WIDTH = 50
#: Windows that one range may hold, and with it the widest window.
RANGE = 1 << 16
ROUNDS = 3
#: Odd multipliers of the two rolling hashes and of names of pairs and runs. Fixed values.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
PAIR, RUN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: What draws the sides of the symbols in each round.
SIDES = tuple(np.uint64((r + 1) * int(PAIR) & (1 << 64) - 1) for r in range(16))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as they were asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.bases = (int(base), pow(int(base), -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def up_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) <= n:
            size = len(self.tables[0])
            self.tables = [np.concatenate([t, t * np.uint64(pow(b, size, 1 << 64))]) for t, b in zip(self.tables, self.bases, strict=True)]
        return self.tables[0], self.tables[1]


_POWERS = tuple(Powers(b) for b in BASES)


class Rolling:
    """128-bit hashes of any span of a sequence of words, alike for equal spans of all sequences."""

    def __init__(self, names: np.ndarray) -> None:
        n = len(names)
        self.sums = []
        for half, powers in enumerate(_POWERS):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(names[:, half] * powers.up_to(n + 1)[0][:n], out=sums[1:])
            self.sums.append(sums)

    def of(self, half: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self.sums[half]
        return mixed((sums[end] - sums[start]) * _POWERS[half].up_to(len(sums))[1][start])


def levels(names: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level of recompression: the symbols, and the start and end of the span that settles each.

    Where a symbol depends on what would come before or after its text, its span reaches one word beyond the text, where no window is.
    """
    n = len(names)
    sym, lo = names[:, 0].copy(), np.arange(n)
    hi = lo + 1
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = [(sym, lo, hi)]
    for r in range(rounds):
        if not len(sym):
            break
        if r % 2 == 0:  # runs of one symbol
            first = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])])
            last = np.r_[first[1:], len(sym)] - 1
            count = (last - first + 1).astype(np.uint64)
            new = np.where(count > 1, mixed(sym[first] * RUN + count), sym[first])
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(sym) - 1)
            d = doc[first]
            new_lo = np.where((first > 0) & (doc[before] == d), lo[before], starts[d] - 1)
            hi = np.where((last + 1 < len(sym)) & (doc[after] == d), hi[after], starts[d + 1] + 1)
            sym, lo, doc = new, new_lo, d
        right = (mixed(sym + SIDES[r]) & np.uint64(1)).astype(bool)
        same = doc[1:] == doc[:-1]
        joins = np.r_[~right[:-1] & right[1:] & same, False]  # a left symbol before a right one; such pairs never overlap
        taken = np.r_[False, joins[:-1]]
        before, after = np.maximum(np.arange(len(sym)) - 1, 0), np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
        new_lo = np.where(right & ~taken, np.where(np.r_[False, same], lo[before], starts[doc] - 1), lo)
        new_hi = np.where(joins, hi[after], np.where(~right, np.where(np.r_[same, False], hi[after], starts[doc + 1] + 1), hi))
        new = np.where(joins, mixed(sym * PAIR + mixed(sym[after])), sym)
        keep = ~taken
        sym, lo, hi, doc = new[keep], new_lo[keep], new_hi[keep], doc[keep]
        out.append((sym, lo, hi))
    return out


def smallest(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest value at first..last (inclusive, never empty), by a table of minima over powers of two."""
    tables = [values]
    while (1 << len(tables)) <= int((last - first).max(initial=0)) + 1:
        half, t = 1 << (len(tables) - 1), tables[-1]
        tables.append(np.minimum(t[:-half], t[half:]) if len(t) > half else t)
    size = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k, t in enumerate(tables):
        at = np.flatnonzero(size == k)
        out[at] = np.minimum(t[first[at]], t[last[at] - (1 << k) + 1])
    return out


def elected(names: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Ranges of windows that elect one symbol: first window, number of windows, and the start and end of the settled span."""
    n = int(starts[-1])
    counts = np.maximum(np.diff(starts) - width + 1, 0)
    todo = np.repeat(starts[:-1] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(int(counts.sum()))
    span_lo, span_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    windows = todo
    for sym, lo, hi in reversed(levels(names, starts)):
        if not len(todo):
            break
        ends = np.cumsum(np.bincount(np.clip(lo + 1, 0, n + 1), minlength=n + 2))  # ends[s]: symbols whose span starts before s
        begins = np.cumsum(np.bincount(np.clip(hi, 0, n + 1), minlength=n + 2))  # begins[e]: symbols whose span ends by e
        first, last = ends[todo], begins[todo + width] - 1
        has = first <= last
        at = todo[has]
        if len(at):
            bits = np.uint64(max(1, int(len(sym)).bit_length()))
            ranked = (mixed(sym) >> bits << bits) | np.arange(len(sym), dtype=np.uint64)  # ties go to the left
            best = (smallest(ranked, first[has], last[has]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            span_lo[at], span_hi[at] = lo[best], hi[best]
        todo = todo[~has]
    if not len(windows):
        return (windows,) * 4
    lo, hi = span_lo[windows], span_hi[windows]
    new = np.flatnonzero(np.r_[True, (np.diff(windows) != 1) | (np.diff(lo) != 0) | (np.diff(hi) != 0)])
    return windows[new], np.diff(np.r_[new, len(windows)]), lo[new], hi[new]


def copy_of(text: bytes) -> int:
    """A hash that tells rows with one doc_id and different texts apart."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def ranges(docs: DataFrame, width: int) -> DataFrame:
    """A row for each range of windows that elect one symbol: key, r1, r2 (hash of the range's words), doc_id, copy, range (first window * RANGE + windows; negative if known to repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = utf8(b.column("text"))
            names, starts = named_words(texts)
            first, count, lo, hi = elected(names, starts, width)
            rolling = Rolling(names)
            doc = np.searchsorted(starts, first, "right") - 1
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            copies = np.array([copy_of(t) for t in texts], np.int64)[doc] if len(texts) else np.zeros(0, np.int64)
            key = rolling.of(0, lo, hi) + (hi - lo).astype(np.uint64)
            end = first + count - 1 + width
            r1, r2, packed = rolling.of(0, first, end), rolling.of(1, first, end), (first - starts[doc]) * RANGE + count
            # Of equal ranges in one batch, those of the first document speak for all: the others are known to repeat. Those get keys of their own, so
            # that the rows of a very common passage are few where its key goes.
            order = np.lexsort((ids, r2, r1, key))
            k, a, b_ = key[order], r1[order], r2[order]
            head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b_[1:] != b_[:-1])]) if len(order) else order
            least = np.repeat(ids[order][head], np.diff(np.r_[head, len(order)]))
            known = order[ids[order] > least]
            key[known] = mixed(key[known] + mixed(ids[known].astype(np.uint64) + packed[known].astype(np.uint64) * PAIR))
            packed[known] = -packed[known]
            columns = [key, r1, r2, ids, copies, packed]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False) if c.dtype != np.uint64 else c.view(np.int64)) for c in columns], names=["key", "r1", "r2", "doc_id", "copy", "range"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, r1 long, r2 long, doc_id long, copy long, range long")


def marked_ranges(found: DataFrame) -> DataFrame:
    """For each document the ranges that repeat whole (2 * range) and those whose windows must be compared one by one (2 * range + 1)."""
    same = Window.partitionBy("key", "r1", "r2")
    key = Window.partitionBy("key")
    seen = found.select("*", F.min("doc_id").over(same).alias("first_doc"))
    seen = seen.select("*", ((F.min("r1").over(key) != F.max("r1").over(key)) | (F.min("r2").over(key) != F.max("r2").over(key))).alias("unlike"))
    whole = (F.col("first_doc") < F.col("doc_id")) | (F.col("range") < 0)
    return seen.where(whole | F.col("unlike")).groupBy("doc_id", "copy").agg(F.collect_list(F.abs("range") * 2 + F.when(whole, 0).otherwise(1)).alias("marks"))


def window_hashes(texts: DataFrame, width: int) -> DataFrame:
    """A row (w1, w2, doc_id, copy, window) for each window that must be compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in small_batches(batches):
            names, starts = named_words([unpack.decompress(z) for z in b.column("packed").to_pylist()])
            rolling = Rolling(names)
            got: list[np.ndarray] = [np.zeros(0, np.int64)]
            for d, marks in enumerate(b.column("marks")):
                m = np.array(marks.values, np.int64)
                m = m[m & 1 == 1] >> 1
                count = m & (RANGE - 1)
                got.append(np.unique(np.repeat(m // RANGE - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))) + starts[d] if len(m) else m)
            at = np.concatenate(got)
            doc = np.searchsorted(starts, at, "right") - 1
            columns = [rolling.of(0, at, at + width).view(np.int64), rolling.of(1, at, at + width).view(np.int64), *(b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "copy")), at - starts[doc]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["w1", "w2", "doc_id", "copy", "window"])

    return texts.select("doc_id", "copy", "packed", "marks").mapInArrow(run, "w1 long, w2 long, doc_id long, copy long, window long")


def covered(n_words: int, marks: list[int] | None, windows: list[int] | None, width: int) -> np.ndarray:
    """Which of a document's words its marked windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    if marks is not None and len(marks):
        m = np.asarray(marks, np.int64)
        m = m[m & 1 == 0] >> 1
        np.add.at(edges, m // RANGE, 1)
        np.add.at(edges, m // RANGE + (m & (RANGE - 1)) - 1 + width, -1)
    if windows is not None and len(windows):
        w = np.asarray(windows, np.int64)
        np.add.at(edges, w, 1)
        np.add.at(edges, w + width, -1)
    return np.cumsum(edges[:-1]) > 0


def dedup(docs: DataFrame, width: int = WIDTH, kept: str = "kept_text") -> DataFrame:
    """docs (doc_id, text and any other columns) with n_words, n_removed, and kept: the text, or the kept words joined by one space if some went."""
    need(docs, "doc_id", "text")
    if not 1 <= width < RANGE:
        raise ValueError(f"width must be 1 to {RANGE - 1}")
    if clash := {"n_words", "n_removed", kept} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    work = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(F.col(f"`{f.name}`") for f in others), F.lit(0).alias("__")).alias("rest")))
    rest = work.schema["rest"]
    kinds = "doc_id long, copy long, n_words long, packed binary, rest " + rest.dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in small_batches(batches):
            texts = utf8(b.column("text"))
            raw = [packer.compress(t) if given else None for t, given in zip(texts, b.column("text").is_valid().to_pylist(), strict=True)]
            columns = [b.column("doc_id"), pa.array([copy_of(t) for t in texts], pa.int64()), pa.array([len(byte_words(t)) for t in texts], pa.int64()), pa.array(raw, pa.binary()), b.column("rest")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "n_words", "packed", "rest"])

    marks = marked_ranges(ranges(work.select("doc_id", "text"), width))
    texts = cut(work.mapInArrow(pack, kinds).join(marks, ["doc_id", "copy"], "left"))
    compare = texts.where(F.exists("marks", lambda m: m % 2 == 1))
    twin = Window.partitionBy("w1", "w2")
    found = window_hashes(compare, width).select("*", F.min("doc_id").over(twin).alias("first_doc")).where("first_doc < doc_id")
    windows = found.groupBy("doc_id", "copy").agg(F.collect_list("window").alias("windows"))
    out_fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), rest, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(kept, T.StringType())]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in small_batches(batches):
            old, new, removed = [], [], []
            for z, m, w, n in zip(*(b.column(c) for c in ("packed", "marks", "windows", "n_words")), strict=True):
                text = unpack.decompress(z.as_py()) if z.is_valid else None
                gone = covered(n.as_py(), m.values if m.is_valid else None, w.values if w.is_valid else None, width)
                old.append(text)
                removed.append(int(gone.sum()))
                new.append(b" ".join(x for x, g in zip(byte_words(text), gone.tolist(), strict=True) if not g) if removed[-1] else text)
            columns = [b.column("doc_id"), pa.array(old, pa.binary()).cast(pa.string()), b.column("rest"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(new, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out_fields])

    # Rows whose marks can't change any more need no join with compared windows.
    joined = texts.join(windows, ["doc_id", "copy"], "left").select("doc_id", "packed", "marks", "windows", "n_words", "rest")
    done = joined.mapInArrow(drop, T.StructType(out_fields))
    return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns), "n_words", "n_removed", kept)


def query(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Result of op9: a row for each document."""
    out = dedup(docs.select("doc_id", "text"), width)
    # Kept words joined by one space; JVM-side the same class of white space as the words are cut by.
    single = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(single, 256).alias("kept_sha256"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WIDTH - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WIDTH - 2})) AS i FROM w WHERE len(words) >= {WIDTH})),
f AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + {WIDTH})) AS i FROM g JOIN f USING (h) WHERE first_doc < g.doc_id),
p AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
k AS (SELECT p.doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
