"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: marked words are hashed, the others are ignored, so that a replaced word breaks only the seeds
that mark it. The hashes of all places in the benchmark items are joined to those in the documents. A hit puts an item at a diagonal of
the document; around it, words are compared place by place, and an overlap counts where `window` words in a row (or the whole item, if shorter)
agree in at least a share of `similarity`.

Items of `window` words or more have the four MASKS; with the default window and similarity, any overlap that counts is hit by one. Items with fewer words have masks of their own length, one more
than words may be replaced in it, that mark each word in turn: one of them is whole in any overlap that counts. Only lengths that the benchmark has cost anything. An item of fewer
than LEAST words is found where a document is nothing else, as elsewhere it may stand by chance.

Documents are read once. A Bloom filter of the benchmark's hashes, of a fixed size, drops nearly all other hashes where they arise; only
what is left is kept, with the words around it, and joined. The benchmark's side is broadcast when a count shows that it is within MAX_BROADCAST
rows; else the join is dealt by hash, with documents salted so that a passage found in very many of them spreads over tasks. Hits are cut to one for each document, item and diagonal before
words are looked at, so a long copied passage costs its own length.

Words are runs of ASCII letters and digits and of characters outside ASCII, lower-cased.

Defined cases: null and empty texts and items overlap with nothing;
a null doc_id or item_id is kept as null; repeated rows give one row for each place; other columns are ignored; empty tables give an
empty result; of several overlaps of a document and an item, each diagonal gives one row, its longest, and of equally long ones the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import AZ, cut, mixed, need, small_batches, spread, utf8, without

#: The masks of items of a window or more: six marked words of eight to ten. Fixed values.
MASKS = ("11011011", "110101011", "1011001011", "1110010011")
WINDOW, SIMILARITY = 13, 0.8
#: Words of an item that is looked for inside of documents.
LEAST = 5
#: Words kept on each side of a hit.
AROUND = 2 * WINDOW
#: Size of the Bloom filter, and which bits of a hash name its slots.
BLOOM_BITS, BLOOM_SHIFTS = 24, (0, 20, 40)
#: Rows of the benchmark's index up to which it is broadcast (some 20 MB), and salts beyond.
MAX_BROADCAST, SALTS = 500_000, 16
SEED = np.uint64(0xA0761D6478BD642F)
plain_words = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def names_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all words of some texts in a row, and where each text starts, with the end of the last."""
    lists = [plain_words(t.translate(AZ) if t.isascii() else t.decode(errors="replace").lower().encode()) for t in texts]
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for x in lists for w in x), np.int64, int(starts[-1]))
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    return names[at], starts


def masks_of(length: int, window: int, similarity: float) -> list[str]:
    """The masks of items of a length."""
    if length >= window:
        return list(MASKS)
    replaced = length - int(np.ceil(similarity * length - 1e-9)) if length >= LEAST else 0
    return ["".join("1" if k % (replaced + 1) == part else "0" for k in range(length)) for part in range(replaced + 1)] if length else []


def seeds(names: np.ndarray, starts: np.ndarray, lengths: list[int], window: int, similarity: float, items: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask of items of some lengths: the places whose span ends within their text, and the hashes there. Of items only those of the mask's own length count, and of documents, where
    the items are shorter than LEAST, only those of that length."""
    size = np.diff(starts)
    ends = np.repeat(starts[1:], size)
    own = np.repeat(size, size)
    for length in sorted({min(n, window) for n in lengths}):
        for mask in masks_of(length, window, similarity):
            fits = np.arange(len(names)) + len(mask) <= ends
            if length < window and (items or length < LEAST):
                fits &= own == length
            elif items:
                fits &= own >= window
            at = np.flatnonzero(fits)
            h = np.full(len(at), xxhash.xxh3_64_intdigest(f"{length if length < window else 0} {mask}"), np.uint64)
            for k, marked in enumerate(mask):
                if marked == "1":
                    h = (h ^ names[at + k]) * SEED
                    h ^= h >> np.uint64(29)
            yield at, mixed(h)


def slot(hashes: np.ndarray, shift: int) -> np.ndarray:
    return ((hashes >> np.uint64(shift)) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def item_lengths(items: DataFrame, window: int) -> list[int]:
    """The numbers of words that items have, `window` for all that have as many or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sizes = np.unique(np.minimum(np.diff(names_of(utf8(b.column("text")))[1]), window))
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int32))], names=["words"])

    return [r["words"] for r in items.select("text").mapInArrow(run, "words int").distinct().collect() if r["words"]]  # window + 1 rows at most


def item_seeds(items: DataFrame, lengths: list[int], window: int, similarity: float) -> DataFrame:
    """(hash, item_id, item_copy, place, slots) of each place and mask of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            names, starts = names_of(utf8(b.column("text")))
            for at, h in seeds(names, starts, lengths, window, similarity, True):
                item = np.searchsorted(starts, at, "right") - 1
                three = np.stack([slot(h, s) for s in BLOOM_SHIFTS], 1).ravel()
                triples = pa.ListArray.from_arrays(pa.array(np.arange(0, len(three) + 1, len(BLOOM_SHIFTS), dtype=np.int32)), pa.array(three))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("item_id").take(pa.array(item)), b.column("item_copy").take(pa.array(item)), pa.array((at - starts[item]).astype(np.int32)), triples], names=["hash", "item_id", "item_copy", "place", "slots"])

    return items.mapInArrow(run, "hash long, item_id long, item_copy long, place int, slots array<long>")


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, item_copy, item_names): each item's words by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            names, starts = names_of(utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("item_copy"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(names.view(np.int64)))], names=["item_id", "item_copy", "item_names"])

    return items.mapInArrow(run, "item_id long, item_copy long, item_names array<long>")


def bloom(index: DataFrame) -> np.ndarray:
    """The Bloom filter of an index's hashes, summed up in Spark to 2 ** (BLOOM_BITS - 6) rows at most."""
    slot = index.select(F.explode("slots").alias("slot"))
    rows = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    if rows:
        bits[[r["at"] for r in rows]] = [r["bits"] for r in rows]
    return bits


def document_hits(docs: DataFrame, bits: np.ndarray, lengths: list[int], window: int, similarity: float) -> DataFrame:
    """A row for each stretch of a document with seeds that may be the benchmark's: its first word's place, its words by name, the seeds' hashes and places."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for b in small_batches(batches):
            names, starts = names_of(utf8(b.column("text")))
            places, hashes = [], []
            for at, h in seeds(names, starts, lengths, window, similarity, False):
                for shift in BLOOM_SHIFTS:  # the first test leaves few for the others
                    kept = flags[slot(h, shift)]
                    at, h = at[kept], h[kept]
                places.append(at)
                hashes.append(h)
            at, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, hashes))
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            doc = np.searchsorted(starts, at, "right") - 1
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (np.diff(at) > AROUND)])
            last = np.r_[new[1:], len(at)] - 1
            lo = np.maximum(at[new] - AROUND, starts[doc[new]])
            hi = np.minimum(at[last] + max(window, *map(len, MASKS)) + AROUND, starts[doc[new] + 1])
            size = hi - lo
            words = names[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))]
            lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
            count = last - new + 1
            of = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(of), b.column("copy").take(of), pa.array((lo - starts[doc[new]]).astype(np.int64)), lists(size, words.view(np.int64)), lists(count, h.view(np.int64)), lists(count, (at - np.repeat(lo, count)).astype(np.int32))],
                names=["doc_id", "copy", "first", "names", "hashes", "places"],
            )

    return docs.mapInArrow(run, "doc_id long, copy long, first long, names array<long>, hashes array<long>, places array<int>")


def longest_overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int, similarity: float) -> tuple[int, int, int] | None:
    """Start, end (in the item) and equal words of the longest stretch made of windows that agree enough; item word j lies at doc word j + shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    w = min(window, len(item))
    if hi - lo < w:
        return None
    same = item[lo:hi] == doc[lo + shift : hi + shift]
    sums = np.r_[0, np.cumsum(same)]
    good = np.flatnonzero(sums[w:] - sums[:-w] >= similarity * w - 1e-9)
    if not len(good):
        return None
    best = max(((int(p[0]), int(p[-1]) + w) for p in np.split(good, np.flatnonzero(np.diff(good) > w) + 1)), key=lambda p: p[1] - p[0])
    return lo + best[0], lo + best[1], int(sums[best[1]] - sums[best[0]])


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document, item and diagonal with a verified overlap: doc_id, copy (hash of the text), item_id, doc_start, item_start, n_words, n_same, similarity."""
    need(docs, "doc_id", "text")
    need(items, "item_id", "text")
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy")))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("text").alias("item_copy"))
    lengths = item_lengths(items, window)
    index = item_seeds(items, lengths, window, similarity)
    small = index.count() <= MAX_BROADCAST
    entries = index.select("hash", "item_id", "item_copy", "place").distinct()
    words = item_words(items).distinct()
    # Rows that repeat are one from here on.
    found = cut(document_hits(docs, bloom(index), lengths, window, similarity).dropDuplicates(["doc_id", "copy", "first"]))
    hits = found.select("doc_id", "copy", "first", F.explode(F.arrays_zip("hashes", "places")).alias("hit"))
    hits = hits.select("doc_id", "copy", "first", F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("at"))
    item = ["item_id", "item_copy"]
    if small:
        joined = hits.join(F.broadcast(entries), "hash")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        joined = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS)).cast("int")).join(entries.select("*", salts), ["hash", "salt"])
    diagonals = joined.select("doc_id", "copy", "first", *item, (F.col("at") - F.col("place")).alias("shift")).distinct()
    stretch = found.select(F.col("doc_id").alias("of_doc"), F.col("copy").alias("of_copy"), F.col("first").alias("of_first"), "names")
    placed = diagonals.join(stretch, diagonals["doc_id"].eqNullSafe(stretch["of_doc"]) & (diagonals["copy"] == stretch["of_copy"]) & (diagonals["first"] == stretch["of_first"]))
    pairs = placed.join(F.broadcast(words) if small else words, [placed[c].eqNullSafe(words[c]) for c in item]).select("doc_id", "copy", "first", "names", placed["item_id"], placed["item_copy"], "shift", "item_names")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            kept, out = [], []
            columns = [b.column(c) for c in ("names", "item_names", "shift", "first")]
            for r, (doc, own, shift, first) in enumerate(zip(*columns, strict=True)):
                got = longest_overlap(doc.values.to_numpy(), own.values.to_numpy(), shift.as_py(), window, similarity)
                if got and (len(own.values) >= LEAST or (len(doc.values) == len(own.values) and first.as_py() == 0)):
                    kept.append(r)
                    out.append((first.as_py() + shift.as_py() + got[0], got[0], got[1] - got[0], got[2]))
            of, values = pa.array(kept, pa.int64()), np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(c).take(of) for c in ("doc_id", "copy", "item_id")] + [pa.array(values[:, k]) for k in range(4)], names=["doc_id", "copy", "item_id", "doc_start", "item_start", "n_words", "n_same"])

    seen = pairs.mapInArrow(verify, "doc_id long, copy long, item_id long, doc_start long, item_start long, n_words long, n_same long")
    best = F.max_by(F.struct("doc_start", "item_start", "n_words", "n_same"), F.struct("n_words", -F.col("doc_start"), "n_same")).alias("best")
    one = seen.groupBy("doc_id", "copy", "item_id", (F.col("doc_start") - F.col("item_start")).alias("shift")).agg(best)
    return one.select("doc_id", "copy", "item_id", "best.*").withColumn("similarity", F.col("n_same") / F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any overlap, as they were."""
    return without(docs, overlaps(docs, items))


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Result of op2: a row for each document, item and diagonal with an overlap."""
    return overlaps(docs, items).drop("copy")


#: Every stretch of every item in every document by comparing all places; a document's longest on each diagonal. Items under LEAST words count where they are the whole document.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS size, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
bw AS (SELECT item_id, len(w) AS words, unnest(range(len(w))) AS j, unnest(w) AS word FROM b),
m AS (SELECT doc_id, size, item_id, words, least(words, {WINDOW}) AS wide, i - j AS shift, list(j ORDER BY j) AS js FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) >= {SIMILARITY} * wide - 1e-9),
s AS (SELECT m.*, unnest(range(greatest(0, -shift), least(words, size - shift) - wide + 1)) AS s FROM m),
g AS (SELECT * FROM s WHERE len(list_filter(js, lambda j: j >= s AND j < s + wide)) >= {SIMILARITY} * wide - 1e-9 AND (words >= {LEAST} OR (words = size AND shift = 0))),
n AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY s) > wide THEN 1 ELSE 0 END AS new FROM g),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id, shift ORDER BY s ROWS UNBOUNDED PRECEDING) AS part FROM n),
p AS (SELECT doc_id, item_id, shift, part, any_value(js) AS js, min(s) AS lo, max(s) + any_value(wide) AS hi FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY hi - lo DESC, lo) AS rank FROM p),
o AS (SELECT doc_id, item_id, lo + shift AS doc_start, lo AS item_start, hi - lo AS n_words, len(list_filter(js, lambda j: j >= lo AND j < hi)) AS n_same FROM r WHERE rank = 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(doc_start AS BIGINT) AS doc_start, CAST(item_start AS BIGINT) AS item_start, CAST(n_words AS BIGINT) AS n_words, CAST(n_same AS BIGINT) AS n_same, n_same / n_words AS similarity FROM o
"""
