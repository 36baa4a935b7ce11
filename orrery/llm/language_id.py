"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of four sources, normalised:

* the text: a model of byte trigrams for each language, with counts from all documents that declare it, smoothed; a text's likelihood is
  tempered to TEMPER trigrams, as trigrams of a text aren't independent;
* the declared language (markup's or the table's): how often a language declares this value, over all documents;
* the address's suffix, and the host: priors by grouped sums of what the texts say, smoothed hierarchically: a host's towards its suffix's, a suffix's
  towards the whole corpus's. A document's own text is taken out of its host's sums first.

One more class, "und", spreads evenly over all trigrams. A document is rejected if it has no letters, if "und" wins, or if the best language's
posterior is under MIN_POSTERIOR; but one with letters whose declared language has no model keeps what it declares, as nothing speaks against it.

A declared value has a model if its texts hold MIN_TRIGRAMS trigrams, however large the rest of the corpus is, or if it has MIN_SHARE of the rows (in
tables with little text).

Texts are read for their sizes, for the counts (once for each GROUP of languages, which bounds a task's counts; a model is 256 KB) and for the likelihoods, of which a short row for each
document is kept. Priors join by host and declared value: they are broadcast when a count shows up to MAX_BROADCAST groups, else joined by
shuffle, for which each key's documents are dealt to SALTS tasks; sums have partial sums on the map side. So a host with a third of all documents is no hot spot.

Defined cases: a null or empty text, or one without letters, is rejected as "und"; a null declared value or address is a group of its own and
is evidence like any other value; without a declaration in the whole table there is no model, and all rows are "und"; an empty declared value declares nothing; rows that repeat give a row
each; other columns pass through, and a clashing output name raises an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import cut, need, small_batches, spread, utf8, without
from orrery.llm.packed_sums import total

#: Buckets of trigrams; trigrams, or else the share of rows, that make a declared value a language; trigrams that a text's evidence counts as, at most.
BUCKETS, MIN_TRIGRAMS, MIN_SHARE, TEMPER = 1 << 16, 1000, 0.002, 60.0
#: Languages whose trigrams are counted at once.
GROUP = 64
#: Weight of the parent in the smoothing of priors, in documents; prior of "und"; least posterior of a document that stays.
SMOOTH, UND_PRIOR, MIN_POSTERIOR = 20.0, 1e-3, 0.5
#: Groups up to which their sums are broadcast, and tasks that a key's documents are dealt to beyond.
MAX_BROADCAST, SALTS = 100_000, 32
UND = "und"
#: Bytes of letters: ASCII letters, lower-cased, and all bytes of longer characters; anything else parts words.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all byte trigrams with a letter in the middle, and the text that each is in."""
    joined = LETTERS[np.frombuffer(b" " + b" \n ".join(texts) + b" ", np.uint8)]
    code = joined.astype(np.uint32)
    middle = np.flatnonzero(code[1:-1] != 32) + 1
    # A few thousand trigrams are in use; a multiplicative hash spreads them over the buckets.
    three = (code[middle - 1] << np.uint32(16)) | (code[middle] << np.uint32(8)) | code[middle + 1]
    ends = np.cumsum([len(t) + 3 for t in texts])
    return ((three * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), np.searchsorted(ends, middle, "right")


def languages(docs: DataFrame, declared: str) -> dict[str, bool]:
    """Declared values whose texts may hold MIN_TRIGRAMS trigrams, or with at least MIN_SHARE of the rows that declare any, and whether they have that share."""
    counts = docs.where(F.col(declared).isNotNull()).groupBy(declared).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    least = F.lit(MIN_SHARE) * (counts.agg(F.sum("n")).first()[0] or 0)
    found = counts.select(declared, (F.col("n") >= least).alias("share"), "bytes").where(F.col("share") | (F.col("bytes") >= MIN_TRIGRAMS))
    return {r[0]: r["share"] for r in found.orderBy(declared).collect() if r[0]}


def trigram_counts(docs: DataFrame, declared: str, names: list[str]) -> np.ndarray:
    """How often each bucket occurs in the texts that declare each language."""
    out = np.zeros((len(names), BUCKETS), np.int64)
    for first in range(0, len(names), GROUP):
        place = {n: i for i, n in enumerate(names[first : first + GROUP])}

        def add(sums: np.ndarray, batch: pa.RecordBatch, place: dict[str, int] = place) -> None:
            for b in small_batches([batch]):
                own = np.array([place.get(x, -1) for x in b.column(declared).to_pylist()], np.int64)
                bucket, doc = trigrams(utf8(b.column("text")))
                of = own[doc] if len(doc) else doc
                sums += np.bincount((of * BUCKETS + bucket)[of >= 0], minlength=len(sums))[: len(sums)]

        out[first : first + GROUP] = total(docs.select("text", declared), len(place) * BUCKETS, add).reshape(len(place), BUCKETS)
    return out


def models(counts: np.ndarray) -> np.ndarray:
    """For each language, and at last for "und", the log probability of each bucket."""
    smooth = counts + 0.5
    uniform = np.full((1, BUCKETS), -np.log(BUCKETS))
    return np.vstack([np.log(smooth / smooth.sum(1, keepdims=True)), uniform]).astype(np.float32)


def likelihoods(docs: DataFrame, logs: np.ndarray) -> DataFrame:
    """docs with letters (number of trigrams) and loglik (tempered, for each language and "und"), without the text."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in small_batches(batches):
            bucket, doc = trigrams(utf8(b.column("text")))
            n = np.bincount(doc, minlength=b.num_rows)
            sums = np.stack([np.bincount(doc, row[bucket], minlength=b.num_rows) for row in table], 1).astype(float)  # bincount of nothing gives integers
            sums *= (np.minimum(n, TEMPER) / np.maximum(n, 1))[:, None]
            width = len(table)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width, dtype=np.int32)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(n.astype(np.int64)), lists], names=[*(f.name for f in fields), "letters", "loglik"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("letters", T.LongType()), T.StructField("loglik", T.ArrayType(T.DoubleType()))]))


def host_of(address):
    """The host of an address: what stands between // and the next / or :, or the whole string if there is no //."""
    return F.regexp_extract(F.regexp_replace(address, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "^([^/:?#]*)", 1)


def normal(logs):
    """Probabilities from an array of logs."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def identify(docs: DataFrame, declared: str | None = None, address: str | None = None, names: list[str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, copy (hash of the text), language, posterior, rejected, letters.

    declared, address: columns with a declared language and an address or host. Without declared, names and a model can't be learnt.
    """
    need(docs, "doc_id", "text", *(c for c in (declared, address) if c))
    as_is = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    work = spread(docs.select("doc_id", "text", F.xxhash64("text").alias("copy"), as_is(declared).alias("declared"), host_of(as_is(address)).alias("host")))
    share = languages(work, "declared") if names is None else dict.fromkeys(names, True)
    counts = trigram_counts(work, "declared", list(share))
    enough = [s or n >= MIN_TRIGRAMS for s, n in zip(share.values(), counts.sum(1).tolist(), strict=True)]
    names, counts = [n for n, e in zip(share, enough, strict=True) if e], counts[np.array(enough, bool)]
    # Languages that lack a model can't be told from "und", so a declaration of one stands.
    unmodelled = (F.coalesce(F.col("declared"), F.lit("")) != "") & (~F.col("declared").isin(names) if names else F.lit(True))
    size = len(names)
    if not names:
        stays = unmodelled & (F.col("letters") > 0)
        return likelihoods(work, models(counts)).select("doc_id", "copy", F.when(stays, F.col("declared")).otherwise(UND).alias("language"), F.lit(0.0).alias("posterior"), (~stays).alias("rejected"), "letters")
    scored = likelihoods(work, models(counts)).withColumn("suffix", F.when(F.instr("host", ".") > 0, F.element_at(F.split("host", r"\."), -1)))
    scored = cut(scored.withColumn("says", F.when(F.col("letters") > 0, F.slice(normal(F.col("loglik")), 1, size)).otherwise(F.array_repeat(F.lit(0.0), size))))

    def sums(*keys: str) -> DataFrame:
        return scored.groupBy(*keys).agg(F.array(*(F.sum(F.col("says")[i]) for i in range(size))).alias("sums"))

    flat = F.array_repeat(F.lit(1.0 / size), size)
    smoothed = lambda own, parent: F.zip_with(own, parent, lambda x, p: (x + SMOOTH * p) / (F.aggregate(own, F.lit(0.0), lambda a, y: a + y) + SMOOTH))
    whole = sums().select(F.transform("sums", lambda x: F.coalesce(x, F.lit(0.0))).alias("all_sums"))
    # One row of as many numbers as languages.
    everywhere = F.array(*(F.lit(float(x)) for x in (whole.first()["all_sums"] or [0.0] * size)))
    suffixes = sums("suffix").select("suffix", smoothed(F.col("sums"), smoothed(everywhere, flat)).alias("suffix_prior"))
    by_host = sums("host").withColumnRenamed("sums", "host_sums")
    by_value = sums("declared").withColumnRenamed("sums", "value_sums")

    def attach(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
        small = cut(small.withColumnRenamed(key, f"{key}_"))
        if small.count() <= MAX_BROADCAST:
            side = F.broadcast(small)
            return rows.join(side, rows[key].eqNullSafe(side[f"{key}_"]), "left").drop(f"{key}_")
        # Each key's documents are dealt to SALTS tasks, and its group of sums goes to all of them.
        side = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(SALTS)).cast("int"))
        return dealt.join(side, dealt[key].eqNullSafe(side[f"{key}_"]) & (dealt["salt"] == side["salt_"]), "left").drop(f"{key}_", "salt", "salt_")

    fused = attach(attach(attach(scored, suffixes, "suffix"), by_host, "host"), by_value, "declared")
    others = F.zip_with("host_sums", "says", lambda h, own: F.greatest(h - own, F.lit(0.0)))
    # How often a language declares this value: the value's sum for it, over the language's own sum, smoothed to one document in SMOOTH.
    declares = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.log((F.get("value_sums", i) + 1.0 / SMOOTH) / (F.get(everywhere, i) + 1.0)))
    fused = fused.withColumn("prior", smoothed(others, F.col("suffix_prior"))).withColumn("declares", declares)
    logs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get("loglik", i) + F.log(F.get("prior", i) * (1 - UND_PRIOR)) + F.get("declares", i))
    nothing = F.get("loglik", F.lit(size)) + F.lit(float(np.log(UND_PRIOR))) + F.array_max("declares")
    fused = fused.withColumn("posteriors", normal(F.concat(logs, F.array(nothing))))
    top = F.array_max("posteriors")
    best = F.array_position("posteriors", top).cast("int")
    unclear = (best == size + 1) | (top < MIN_POSTERIOR)
    rejected = (F.col("letters") == 0) | (unclear & ~unmodelled)
    language = F.when(rejected, UND).when(unclear, F.col("declared")).otherwise(F.element_at(F.array(*map(F.lit, names), F.lit(UND)), best))
    return fused.select("doc_id", "copy", language.alias("language"), top.alias("posterior"), rejected.alias("rejected"), "letters")


def known(docs: DataFrame, declared: str = "lang", address: str = "source") -> DataFrame:
    """The documents that aren't rejected, as they were."""
    return without(docs, identify(docs, declared, address).where("rejected"))


def query(docs: DataFrame) -> DataFrame:
    """Result of op7: a row for each document, with its lang column as what is declared and its source as the host."""
    return identify(docs, "lang", "source").drop("copy").withColumn("posterior", F.round("posterior", 6))
