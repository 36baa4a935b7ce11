"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles, named by 64-bit hashes. All documents order their tokens alike: by how often they
occur, then by hash. Two sets that reach the threshold share a token among the first P = n - o + 1 of each (o: the least
overlap that a set of n can link with), and t tokens among the first P + t - 1. Rare tokens among the first P are indexed singly. If
the first common token is frequent, then all are; the frequent tokens of the prefix, extended to P + g, are dealt to g groups by hash, and g + 1
common ones put two into one group: so pairs of frequent tokens of one group are indexed, some two or four for each token. The
number of groups grows with P in powers of two; a set uses those of all sizes that its partners may have, and a pair of sets meets under that of the larger.

How often tokens occur, and which classes are frequent, comes from counts over all documents, in a sketch of a fixed size: a token has its slot's
count, and is frequent if that is far above the mean. A slot shared by chance changes the order alone, never the result.

Equal sets become one first. A key's documents, sorted by size, fall apart where the next is too large to link with the one before; such chains replace the key, and documents
alone in one leave. Where two are left, they are compared. In larger chains the document whose token comes first leads. A round compares each document with
one leader of its chains, of another component, and links what verifies; so a group of m near copies costs about m comparisons and not m * m. When few enough pairs
in unlike components are left, when a round has hardly lessened them, or after ROUNDS rounds, parity sketches of all of them are compared, chain by chain in pieces of bounded size, with the documents outside of the chain's
largest component on one side, and chains of near copies that hold nearly the same documents as one; only pairs that may link leave a piece. No pair that reaches the threshold is left out: its two documents end in
one component, or are compared.

Parity sketches of the sets rule out most pairs that are far apart. Verification intersects the whole sets, for documents that occur in what is left. Links join to components by contraction.

Defined cases: A-Z are lower-cased; with fewer words than a shingle has, the sequence is one token; null and blank texts have empty sets and
link with nothing; rows that repeat a doc_id are one document with the links of all of them, and give a row each; rows with a null doc_id
link with nothing and have a null component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import AZ, MAX_BROADCAST_IDS, cut, cut_plain, cut_short, free_name, mixed, named_words, need, short, small_batches, spread, utf8
from orrery.llm.components import components
from orrery.llm.packed_sums import total

WORDS, PERCENT = 3, 90
#: Tokens of a prefix for each group of frequent tokens, at least.
IN_GROUP = 4
#: Slots of the sketch of counts (8 MB) and of the filter of documents that occur in pairs (1 MB), whatever the input's size.
COUNT_BITS, FILTER_BITS = 20, 23
#: Bits of a set's parity sketch.
PARITY_BITS = 1024
#: Rounds that compare each document with one leader, before all that is left is compared; fewer where that is little.
ROUNDS = 4
#: The share of a round's pairs from which, if more are left, leaders have no more to give and all that is left is compared.
STALLED = 0.9
#: Pairs for each document whose sketches are compared at once when so many or fewer are left, before the bounds on sizes and places thin them out.
ENOUGH = 100
#: Documents of a chain in a slice; two slices meet in a piece.
SLICE = 2048
#: Documents of a chain from which chains around one component may become one, and how many times the largest of them they may hold.
ALIKE, ALIKE_SHARE = 16, 4
SHINGLE, MASK = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


def token_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct tokens in a row, each text's in ascending order, and where each text's begin, with the end of the last."""
    names, starts = named_words([t.translate(AZ) for t in texts])
    names = names[:, 0]
    length = np.diff(starts)
    n = int(starts[-1])
    # A shingle's name folds its words from the last to the first; a short text's only shingle folds what is there.
    shingle = np.zeros(n, np.uint64)
    end = np.repeat(starts[1:], length)
    at = np.arange(n)
    for k in reversed(range(words)):
        there = at + k < end
        shingle = np.where(there, mixed(shingle * SHINGLE + names[np.minimum(at + k, max(n - 1, 0))] + np.uint64(k + 1)), shingle) if n else shingle
    place = at - np.repeat(starts[:-1], length)
    keep = (place <= np.repeat(length, length) - words) | (place == 0)
    doc = np.repeat(np.arange(len(texts)), length)[keep]
    shingle = shingle[keep]
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])] if len(doc) else np.zeros(0, bool)
    doc, shingle = doc[new], shingle[new]
    return shingle, np.searchsorted(doc, np.arange(len(texts) + 1))


def least_overlap(n: int, percent: int) -> int:
    """The least number of common tokens with which a set of n can reach the threshold."""
    return -(-percent * n // 100)


def slot_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How often tokens of each slot of the sketch occur, over all documents; at most 2 ** 16 - 1 is kept."""
    size = 1 << COUNT_BITS

    def add(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        for b in small_batches([batch]):
            tokens, _ = token_sets(utf8(b.column("text")), words)
            counts += np.bincount((tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=size)

    counts = total(docs.select("text"), size, add)
    # Counts are scaled so that the mean keeps eight bits or fewer: the order of slots is what matters.
    return np.minimum(counts // max(1, int(counts.mean()) >> 8), 65535).astype(np.uint16)


def often(counts: np.ndarray) -> int:
    """The count from which a slot's tokens are in the frequent class: far above the mean of all slots."""
    mean = float(counts.mean())
    return int(mean + 4 * np.sqrt(mean) + 8)


def prefix(n: int, percent: int) -> int:
    """How many of a set's first tokens hold one that it shares with any partner."""
    return n - least_overlap(n, percent) + 1


def groups(n: int, percent: int) -> int:
    """Into how many groups the frequent tokens of a set of n fall: a power of two."""
    return 1 << max(0, (prefix(n, percent) // IN_GROUP).bit_length() - 1)


def combinations(tokens: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of tokens in one of `number` groups, and each pair's first token's index; tokens are in the common order."""
    group = (mixed(tokens ^ MASK) & np.uint64(number - 1)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    tokens, group = tokens[order], group[order]
    salt = mixed(np.array([number], np.uint64))
    keys, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for apart in range(1, len(tokens)):
        i = np.flatnonzero(group[:-apart] == group[apart:])
        if not len(i):
            break
        keys.append(mixed((tokens[i] * SHINGLE + tokens[i + apart]) ^ salt))
        firsts.append(order[i])
    return np.concatenate(keys), np.concatenate(firsts)


def signature(tokens: np.ndarray, rare: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set of n whose first tokens are given in the common order: rare ones of its prefix, then combinations, with the least place that the first common token of a pair of sets may have for each of these."""
    first = prefix(n, percent) if n else 0
    keys, places = [tokens[:first][rare[:first]]], [np.zeros(0, np.int64)]
    if len(keys[0]) < first:
        number, most = groups(n, percent), groups(n * 100 // percent, percent)
        while number <= most:
            at = np.flatnonzero(~rare[: first + number])
            pairs, of = combinations(tokens[at], number)
            keys.append(pairs)
            places.append(np.maximum(at[of] - (number - 1), 0))
            number *= 2
    return np.concatenate(keys), np.concatenate(places)


def keyed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row for each document: doc_id, n, s1, s2 (a hash of the set), keys, places (of the combinations, which are the last keys; before them, a key's place is its index), parity."""
    counts = slot_counts(docs, words)
    shared, least_often = docs.sparkSession.sparkContext.broadcast(counts), often(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of = shared.value
        for b in small_batches(batches):
            tokens, starts = token_sets(utf8(b.column("text")), words)
            count = count_of[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
            ranked = (count.astype(np.uint64) << np.uint64(48)) | (mixed(tokens) >> np.uint64(16))
            names, more = mixed(tokens + np.uint64(1)), mixed(tokens ^ SHINGLE)
            slot = np.repeat(np.arange(b.num_rows), np.diff(starts)) * PARITY_BITS + (names & np.uint64(PARITY_BITS - 1)).astype(np.int64)
            odd = np.bincount(slot, minlength=b.num_rows * PARITY_BITS).reshape(b.num_rows, -1).astype(np.uint8) & 1
            parity = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
            sizes, s1, s2, keys, places = [], [], [], [], []
            for d in range(b.num_rows):
                lo, hi = int(starts[d]), int(starts[d + 1])
                n = hi - lo
                sizes.append(n)
                s1.append(int(names[lo:hi].sum(dtype=np.uint64)) - (1 << 63))
                s2.append(int(more[lo:hi].sum(dtype=np.uint64)) - (1 << 63))
                first = np.argsort(ranked[lo:hi], kind="stable")[: prefix(n, percent) + groups(n * 100 // percent, percent)]
                own, place = signature(tokens[lo:hi][first], count[lo:hi][first] < least_often, n, percent)
                keys.append(own.view(np.int64))
                places.append(place.astype(np.int32))
            of = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)), pa.array(np.concatenate(parts) if parts else [], kind))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), of(keys, pa.int64()), of(places, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * parity.shape[1]), pa.array(parity.ravel()))], names=["doc_id", "n", "s1", "s2", "keys", "places", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, keys array<long>, places array<int>, parity array<long>")


def chains(index: DataFrame, percent: int) -> DataFrame:
    """Of an index (key, doc, n, place) the chains of two documents or more: key, doc, n, place, m (documents of the chain), rank, and the leader's lead_doc, lead_n, lead_place.

    One shuffle by key: sorted by size, a key falls apart where no document of one part can link with any of the other.
    """
    by_size = Window.partitionBy("key").orderBy("n", "doc")
    sorted_ = index.select("*", F.lag("n").over(by_size).alias("smaller"), F.lead("n").over(by_size).alias("larger"))
    begins = F.coalesce(100 * F.col("smaller") < percent * F.col("n"), F.lit(True))
    ends = F.coalesce(100 * F.col("n") < percent * F.col("larger"), F.lit(True))
    linked = sorted_.where(~(begins & ends)).select("key", "doc", "n", "place", F.sum(begins.cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"))
    chain = Window.partitionBy("key", "chain")
    by_place = chain.orderBy("place", "doc")
    # A document that can't even link with the smallest of its chain, as too many of its tokens come before this key, can link with none.
    least = F.min("n").over(chain)
    linked = linked.withColumn("least", least).where((100 + percent) * (F.col("n") - F.col("place")) >= percent * (F.col("n") + F.col("least"))).drop("least")
    lead = F.first(F.struct("doc", "n", "place")).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    found = linked.select("*", F.count("*").over(chain).alias("m"), F.row_number().over(by_place).alias("rank"), lead.alias("lead"))
    return found.select(F.xxhash64("key", "chain").alias("key"), "doc", "n", "place", "m", "rank", *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("doc", "n", "place")))


def _slot(column):
    return F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS)


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, tokens) of the documents in ids. A filter of a fixed size keeps most others' texts from being read through at all."""
    spark = docs.sparkSession
    slots = ids.select(_slot("id").alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = slots.collect()  # 2 ** (FILTER_BITS - 6) rows at most
    bits[[r["at"] for r in rows]] = [r["bits"] for r in rows]
    kept = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of_bits = kept.value
        for whole in batches:
            slot = whole.column("slot").to_numpy()
            whole = whole.filter(pa.array(((words_of_bits[slot >> 6] >> (slot & 63)) & 1).astype(bool)))
            for b in small_batches([whole]):
                tokens, starts = token_sets(utf8(b.column("text")), words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(tokens.view(np.int64)))], names=["doc_id", "tokens"])

    found = docs.select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(run, "doc_id long, tokens array<long>")
    return found.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def not_far(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that parity sketches (doc_id, n, parity) don't rule out.

    A sketch has for each slot whether an odd number of the set's tokens fall there, so the slots in which two sketches differ are at most the tokens that only one of
    the sets has. Too many of them prove that a pair can't reach the threshold; no pair that reaches it is dropped.
    """
    asked = short(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    some = sketches.join(asked, "doc_id", "left_semi")
    side = lambda name: some.select(F.col("doc_id").alias(name), F.col("n").alias(f"{name}_n"), F.col("parity").alias(f"{name}_parity"))
    apart = F.aggregate(F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(docs, ids, words)
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * common >= percent * (F.size("a_tokens") + F.size("b_tokens") - common)).select("a", "b").distinct()


def may_link(percent: int, a: str = "a", b: str = "b"):
    """Whether two documents (n and place of each) can reach the threshold if this key is the first that they have in common."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    most = F.least(n - F.col(f"{a}place"), m - F.col(f"{b}place"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def may_link_all(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """As may_link(), for arrays."""
    most = np.minimum(n - place, m - other)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * most >= percent * (n + m))


def candidates(active: DataFrame, of_key: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of documents of one chain in unlike components that sizes, places and parity sketches don't rule out.

    active: (key, doc, n, place, root); of_key: (key, m, most: the largest component). Each pair has one end outside that component. A chain of more than SLICE documents falls to
    slices by hash, and each two slices are a piece; a piece's rows are sorted together, and its pairs are tested in arrays and never become rows unless they pass.
    """
    docs = short(active.select(F.col("doc").alias("doc_id")))
    rows = active.join(of_key.select("key", "m", F.col("most.root").alias("most")), "key").select("key", "doc", "n", "place", "root", "m", "most")
    # Near copies share most of their chains. Where all chains around one component together hold few more documents than the largest of them, they become one, each document once with its least place.
    held = rows.groupBy("most", "doc").agg(F.max("m").alias("m")).groupBy("most").agg(F.count("*").alias("docs"), F.max("m").alias("m"))
    alike = short(held.where((F.col("m") >= ALIKE) & (F.col("docs") <= ALIKE_SHARE * F.col("m"))).select("most", "docs"))
    merged = rows.join(alike, "most").groupBy("most", "doc", "n", "root").agg(F.min("place").alias("place"), F.max("docs").alias("m")).select(F.col("most").alias("key"), "doc", "n", "place", "root", "m", "most")
    rows = rows.join(alike.select("most"), "most", "left_anti").select(*merged.columns).withColumn("merged", F.lit(0)).unionByName(merged.withColumn("merged", F.lit(1)))
    slices = F.ceil(F.col("m") / SLICE).cast("int")
    rows = rows.withColumn("key", F.xxhash64("key", "merged")).withColumn("own", F.pmod(F.xxhash64("doc"), slices).cast("int"))
    rows = rows.select("key", "doc", "n", "place", "root", "own", (F.col("root") != F.col("most")).alias("out"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("other"))
    rows = rows.join(sketches.join(docs, "doc_id", "left_semi").withColumnRenamed("doc_id", "doc"), ["doc", "n"])
    dealt = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def test(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, n, place, root, own, out = (t.column(c).to_numpy() for c in ("doc", "n", "place", "root", "own", "out"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        parity = t.column("parity").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(doc), -1)
        two = t.column("low")[0].as_py() != t.column("high")[0].as_py()
        a, b = [], []
        for i in np.flatnonzero(out).tolist():
            fine = (root != root[i]) & (~out | (doc[i] < doc)) & may_link_all(n[i], place[i], n, place, percent)
            j = np.flatnonzero(fine & (own != own[i]) if two else fine)
            apart = np.bitwise_count(parity[j] ^ parity[i]).sum(1, dtype=np.int64)
            j = j[(100 + percent) * apart <= (100 - percent) * (n[j] + n[i])]
            a.append(np.full(len(j), doc[i]))
            b.append(doc[j])
        empty = np.zeros(0, np.int64)
        a, b = np.concatenate([empty, *a]), np.concatenate([empty, *b])
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            piece = np.stack([t.column(c).to_numpy() for c in ("key", "low", "high")], 1)
            starts = np.r_[0, np.flatnonzero((piece[1:] != piece[:-1]).any(1)) + 1] if len(piece) else np.zeros(1, np.int64)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in test(t.slice(lo, hi - lo))], names=["a", "b"])
            rest = t.slice(int(starts[-1]))
        if rest is not None and rest.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in test(rest)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id. Two documents link when 100 * common >= percent * all tokens."""
    need(docs, "doc_id", "text")
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, up to 100")
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = cut(keyed(docs, words, percent))
    known = rows.where("doc_id IS NOT NULL")

    # Equal sets become one: its least doc_id stands for the class. Rows with long arrays stay where they are, unless ids repeat.
    own = ["n", "s1", "s2"]
    classes = known.where("n > 0").groupBy(*own).agg(F.min("doc_id").alias("first"))
    members = cut_short(known.select("doc_id", *own).join(classes, own, "left").select("doc_id", "n", "s1", F.coalesce("first", "doc_id").alias("first")))
    gone = short(members.where("doc_id <> first").select("doc_id", "s1"))
    firsts = known.where("n > 0").join(gone, ["doc_id", "s1"], "left_anti")
    repeated = members.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("first").alias("a"), F.max("first").alias("z")).where("rows > 1")
    repeated = cut(repeated)
    repeats = repeated.where("a < z").select("doc_id", "a").join(members, "doc_id").where("a <> first").select("a", F.col("first").alias("b"))
    if not repeated.isEmpty():
        firsts = firsts.dropDuplicates(["doc_id", *own])

    first_combined = F.size("keys") - F.size("places")
    index = firsts.select(F.col("doc_id").alias("doc"), "n", "places", first_combined.alias("singles"), F.posexplode("keys").alias("at", "key"))
    index = index.select("doc", "n", "key", F.when(F.col("at") < F.col("singles"), F.col("at")).otherwise(F.get("places", F.col("at") - F.col("singles"))).alias("place"))
    found = cut(chains(index, percent).where((F.col("m") > 2) | ((F.col("rank") == 2) & may_link(percent, "lead_", ""))))

    # The first round: two documents alone in a chain, and of larger chains one leader for each document.
    led = found.where("rank > 1").where(may_link(percent, "lead_", "")).where("lead_doc <> doc")
    of_many = led.where("m > 2").groupBy("doc").agg(F.min("lead_doc").alias("lead_doc")).select("doc", "lead_doc")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = cut_short(led.where("m = 2").select("doc", "lead_doc").union(of_many).select(*pair("doc", "lead_doc")).distinct())

    sketches = firsts.select("doc_id", "n", "parity")
    shared = found.where("m > 2").select("key", "doc", "n", "place", "rank")
    tested, links = pairs, cut_plain(repeats.union(verified(cut_plain(not_far(pairs, sketches, percent)), docs, words, percent)))
    roots = components(links)
    count = members.count()
    side = lambda df, name: df.select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("doc", "n", "place", "root")))
    in_key = Window.partitionBy("key")
    active, before = shared, float("inf")
    for turn in range(2, ROUNDS + 2):
        # Chains whose documents are in one component are done, and stay so: a round reads what the one before has left, each row once.
        known_roots = roots.select(F.col("node").alias("doc"), "root")
        active = active.join(F.broadcast(known_roots) if known_roots.count() <= MAX_BROADCAST_IDS else known_roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        active = cut(active.select("*", (F.min("root").over(in_key) != F.max("root").over(in_key)).alias("unlike")).where("unlike").drop("unlike"))
        # Each pair that is left has an end outside the component that most of its chain's documents are in.
        of_key = active.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("most"))
        number = of_key.agg(F.sum((F.col("m") - F.col("most.m")) * F.col("m"))).first()[0] or 0
        if number == 0:
            break
        last = turn > ROUNDS or number <= ENOUGH * count + 1_000_000 or number > STALLED * before
        if last:
            near = candidates(active, of_key, sketches, percent)
        else:  # one leader for each document, from either end in turn
            near = side(active.where("rank = 1"), "a").join(side(active.where("rank > 1"), "b"), "key").where(F.col("a_root") != F.col("b_root")).where(may_link(percent, "a_", "b_"))
            near = near.select(*pair("a_doc", "b_doc"), "b_doc", "a_doc").join(tested, ["a", "b"], "left_anti")
            near = near.groupBy("b_doc").agg((F.min if turn % 2 else F.max)("a_doc").alias("a_doc")).select(*pair("a_doc", "b_doc")).distinct()
        pairs = cut_short(near)
        far = (lambda found: found) if last else (lambda found: cut_plain(not_far(found, sketches, percent)))
        links = cut_plain(links.union(verified(far(pairs), docs, words, percent)))
        roots = components(links)
        if last:
            break
        tested, active, before = cut_short(tested.union(pairs)), active.drop("root"), number
    lowest = roots.groupBy("root").agg(F.min("node").alias("component")).join(roots, "root").select(F.col("node").alias("first"), "component")
    result = members.join(lowest, "first", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))
    unknown = rows.where("doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.union(unknown)


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; of rows that repeat an id, one stays. Rows with null ids stay."""
    found = cut(join(docs, words, percent))
    gone = short(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")))
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone_id"))
    if repeated.isEmpty():
        return kept
    repeated = short(repeated)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    rank = free_name(docs.columns, "rank")
    again = kept.join(repeated, kept["doc_id"] == repeated["gone_id"], "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return kept.join(repeated, kept["doc_id"] == repeated["gone_id"], "left_anti").unionByName(again)


def query(docs: DataFrame) -> DataFrame:
    """Result of op10: a row for each document."""
    return join(docs, WORDS, PERCENT)


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + {WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WORDS - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(r.reached) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
"""
