"""Toxicity by noisy-channel deobfuscation.

Tokens that look disguised (signs or digits among letters, letters said three times or more, letters parted by signs or spaces) become lattices of
what each character may stand for: itself, letters that it imitates, nothing if it repeats the last or only parts letters. Viterbi search finds the
likeliest word under a trigram model of letters, which is counted over the whole corpus. The restored text is then scored.

The score starts from features of restored words: the word itself and its beginnings of 4 to 8 bytes, hashed. A feature's weight is the lower end of its
log odds between toxic and other labelled documents, so that what was seen by chance weighs nothing. A word weighs what its best feature does; a
document's strongest words, and its length, go to a logistic model. Weights and model learn from different labelled rows (by a hash of the id), at most MAX_LABELLED of
them; rows that are held out (crc32(doc_id) mod 5 = 0) teach neither. Nothing but the text goes into a score.

A run of single letters, and a token too long for a word, is split into words: letters by the same search with a gap between words, words by how often the corpus
has them. No length is too long for that.

All documents are read for the letter and word counts (a sum of a fixed size), and for the scores; labelled ones also for weights and model. Labels are broadcast, MAX_LABELLED rows at
most. A document needs no other one, so texts are never shuffled.

What goes to the driver and to all executors is bounded: counts of 28 ** 3 letters and 2 ** WORD_BITS words (8 MB), 2 * BUCKETS feature counts (8 MB), labels and evidence of MAX_LABELLED rows (under
5 MB each); with the input grows only how full they are.

Defined cases: of several labels of one id the commoner counts (toxic if even); null and empty texts have no words and get the model's score for that; without labels of both kinds every score is 0; null labels teach nothing; a null doc_id isn't held out; repeated
rows give a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import AZ, byte_words, need, small_batches, spread, utf8
from orrery.llm.packed_sums import total

#: Bound of the labelled rows that weights and model are fitted on; buckets of features; folds by a hash of the id, fold 0 held out, the last for the model.
MAX_LABELLED, BUCKETS, FOLDS = 100_000, 1 << 19, 5
#: Standard deviations that a weight's lower end lies below its estimate, and the least weight that counts.
CAUTION, LEAST = 2.0, 0.7
#: What signs and digits imitate. Fixed values.
IMITATED = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
#: Costs in nats: to drop a repeated letter, a sign between letters, and a sign that could be a letter; to read a sign as a letter.
DROP_REPEAT, DROP_SIGN, DROP_LETTER, IMITATE = 0.3, 0.1, 3.0, 0.5
OTHER, GAP = 26, 27
#: Bytes of a token that is one word at most, and scores of tokens that are kept; longer tokens are split into words.
LONGEST, CACHE_ENTRIES = 64, 300_000
#: Words by hash: bits of it, factors, the longest word counted, and how often a word occurs that is known. Cost of an unknown word, and of each letter in it.
WORD_BITS, LONGEST_WORD, OFTEN, UNKNOWN = 20, 24, 3, (12.0, 4.5)
WORD_SHIFT, MASK, MIX = 64 - WORD_BITS, (1 << 64) - 1, 0x9E3779B97F4A7C15
POWERS = [pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(LONGEST_WORD)]
#: The letter model's classes: a to z, any byte of a longer character, and everything else.
CLASS = np.array([b - 97 if 97 <= b <= 122 else b - 65 if 65 <= b <= 90 else OTHER if b >= 128 else GAP for b in range(256)], np.int64)

disguised = re.compile(rb"[0-9@$!|+(*][a-z]|[a-z][0-9@$*|(]+$|([a-z])\1\1|^(?:[a-z0-9@$!|][.\-_*~'/]+){3,}[a-z0-9@$!|]$").search
tripled = re.compile(rb"([a-z])\1\1").search
thrice, twice = re.compile(rb"([a-z])\1{2,}").sub, re.compile(rb"([a-z])\1+").sub
letters = re.compile(rb"[a-z\x80-\xff]+").findall
edges = b"!?.,;:#%&\"'()[]{}<>~-_=*^`/\\"


class LetterModel:
    """Log probabilities of a letter after two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts[: 28**3].reshape(28, 28, 28).astype(float)
        frequent = np.flatnonzero(counts[28**3 :] >= OFTEN)
        own = counts[28**3 :][frequent]
        self.costs: dict[int, float] = dict(zip(frequent.tolist(), (-np.log(own / max(1, own.sum()))).tolist(), strict=True))
        one = (three.sum((0, 1)) + 1) / (three.sum() + 28)
        two = three.sum(0)
        two = (two + 5 * one[None, :]) / (two.sum(1, keepdims=True) + 5)
        self.logs = np.log((three + 5 * two[None]) / (three.sum(2, keepdims=True) + 5)).tolist()
        self.known: dict[bytes, bytes] = {}

    def restore(self, token: bytes) -> bytes:
        """The likeliest word that a disguised token stands for."""
        word = self.known.get(token)
        if word is None:
            if len(self.known) > 200_000:
                self.known.clear()
            word = self.known[token] = self._viterbi(token)
        return word

    def _viterbi(self, token: bytes) -> bytes:
        states: dict[tuple[int, int], tuple[float, bytes]] = {(GAP, GAP): (0.0, b"")}
        for c in token:
            shown = chr(c)
            reads = [(c, 0.0)] if 97 <= c <= 122 or c >= 128 else [(ord(x), IMITATE) for x in IMITATED.get(shown, "")]
            new: dict[tuple[int, int], tuple[float, bytes]] = {}
            for (a, b), (cost, word) in states.items():
                for x, more in reads:
                    k = int(CLASS[x])
                    to, price = (b, k), cost + more - self.logs[a][b][k]
                    if to not in new or price < new[to][0]:
                        new[to] = (price, word + bytes([x]))
                drop = None
                if word and any(word[-1] == x for x, _ in reads):
                    drop = DROP_REPEAT
                elif not reads:
                    drop = DROP_SIGN
                elif reads[0][1]:
                    drop = DROP_LETTER
                if drop is not None and ((a, b) not in new or cost + drop < new[a, b][0]):
                    new[a, b] = (cost + drop, word)
            states = new
        return min((cost - self.logs[a][b][GAP], word) for (a, b), (cost, word) in states.items())[1]

    def split(self, token: bytes) -> list[bytes]:
        """The likeliest words that a long disguised token, or a run of letters, stands for. Paths share what they have in common, so memory grows with the length alone."""
        logs, states = self.logs, {(GAP, GAP): (0.0, None)}
        start = logs[GAP][GAP]
        for c in token:
            reads = [(c, 0.0)] if 97 <= c <= 122 or c >= 128 else [(ord(x), IMITATE) for x in IMITATED.get(chr(c), "")]
            drop = DROP_SIGN if not reads else DROP_LETTER if reads[0][1] else None
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                end = cost - logs[a][b][GAP]
                for x, more in reads:
                    k = int(CLASS[x])
                    price = cost + more - logs[a][b][k]
                    if (b, k) not in new or price < new[b, k][0]:
                        new[b, k] = (price, (path, x))
                    if b != GAP:  # a new word begins here
                        price = end + more - start[k]
                        if (GAP, k) not in new or price < new[GAP, k][0]:
                            new[GAP, k] = (price, ((path, 32), x))
                if drop is not None and ((a, b) not in new or cost + drop < new[a, b][0]):
                    new[a, b] = (cost + drop, path)
            states = new
        path = min(((cost - logs[a][b][GAP], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])[1]
        out = bytearray()
        while path:
            path, x = path
            out.append(x)
        return self._known_words(thrice(rb"\1\1", bytes(out[::-1]).replace(b" ", b"")))

    def _known_words(self, run: bytes) -> list[bytes]:
        """The cheapest words that make up some letters: frequent words of the corpus, as they stand or with repeated letters dropped, and unknown ones."""
        least, back = [0.0] + [np.inf] * len(run), [(0, b"")] * (len(run) + 1)
        for i in range(len(run)):
            plain = bare = size = dropped = 0
            for j in range(i, min(len(run), i + LONGEST_WORD)):
                c = run[j] - 96 if run[j] < 128 else 27
                plain = plain + c * POWERS[j - i] & MASK
                if j > i and run[j] == run[j - 1]:
                    dropped += 1
                else:
                    bare, size = bare + c * POWERS[size] & MASK, size + 1
                cost = self.costs.get((plain * MIX & MASK) >> WORD_SHIFT, UNKNOWN[0] + UNKNOWN[1] * (j + 1 - i))
                shorter = self.costs.get((bare * MIX & MASK) >> WORD_SHIFT, np.inf) + DROP_REPEAT * dropped if dropped else np.inf
                if least[i] + min(cost, shorter) < least[j + 1]:
                    word = run[i : j + 1]
                    least[j + 1], back[j + 1] = least[i] + min(cost, shorter), (i, twice(rb"\1", word) if shorter < cost else word)
        words, at = [], len(run)
        while at:
            at, word = back[at]
            words.append(word)
        return words[::-1]


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all letter trigrams of all documents, words parted by two gaps before and one after, and at the end of words of letters by hash."""

    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        for b in small_batches([batch]):
            c = CLASS[np.frombuffer(b"  " + b"  ".join(utf8(b.column("text"))) + b" ", np.uint8)]
            before, middle, last = c[:-2], c[1:-1], c[2:]
            kept = (middle != GAP) | ((last != GAP) & (last != OTHER))
            code = np.where(middle == GAP, GAP, before) * 784 + middle * 28 + last  # a word's first letter follows two gaps
            sums[: 28**3] += np.bincount(code[kept], minlength=28**3)
            edge = np.flatnonzero(np.diff((c != GAP).astype(np.int8)))  # texts begin and end with gaps
            first, after = edge[::2] + 1, edge[1::2] + 1
            of = (after - first <= LONGEST_WORD) & (np.diff(np.r_[0, np.cumsum(c == OTHER)][np.stack([first, after])], axis=0)[0] == 0)
            first, size = first[of], (after - first)[of]
            if len(first):
                begin = np.r_[0, np.cumsum(size)[:-1]]
                place = np.arange(int(size.sum())) - np.repeat(begin, size)
                h = np.add.reduceat((c[np.repeat(first, size) + place] + 1).astype(np.uint64) * np.array(POWERS, np.uint64)[place], begin)
                which, n = np.unique((h * np.uint64(MIX)) >> np.uint64(WORD_SHIFT), return_counts=True)
                sums[28**3 + which.astype(np.int64)] += n

    return total(docs.select("text"), 28**3 + (1 << WORD_BITS), add)


def words_of_token(token: bytes, model: LetterModel) -> list[bytes]:
    """The restored words of one token, in small letters."""
    if token.isalpha():
        if not tripled(token):
            return [token]
        return [model.restore(token)] if len(token) <= LONGEST else [token, *model.split(token)]
    core = token.strip(edges) or token
    if not core.isdigit() and disguised(core):
        return [model.restore(core)] if len(core) <= LONGEST else [*letters(core), *model.split(core)]
    return letters(core)


def buckets(word: bytes) -> list[int]:
    """Buckets of a word's features."""
    n = len(word)
    return [xxhash.xxh3_64_intdigest(word, 99) % BUCKETS] + [xxhash.xxh3_64_intdigest(word[:k], k) % BUCKETS for k in range(4, min(n, 9))]


def tokens_of(texts: list[bytes], model: LetterModel) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts; for each place the text and the token there; each text's number of tokens.

    Letters that stand alone, four or more in a row, are a word or several in pieces: the whole run is restored, and its words are added as tokens of
    its text; so is a run of up to LONGEST letters read as one word.
    """
    lists = [byte_words(t.translate(AZ) if t.isascii() else t.decode(errors="replace").lower().encode()) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for x in lists for w in x), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    alone = [i for t, i in index.items() if len(t) == 1 and (t.isalpha() or t.decode("latin-1") in IMITATED)]
    if alone:
        is_alone = np.zeros(len(index), bool)
        is_alone[alone] = True
        single = is_alone[at]
        # A run ends where the letters do, and where the text does.
        new = np.flatnonzero(np.r_[True, (single[1:] != single[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else at
        size = np.diff(np.r_[new, len(at)])
        runs = np.flatnonzero(single[new] & (size >= 4)) if len(at) else at
        known = list(index)
        extra = []
        for r in runs.tolist():
            run = b"".join(known[i] for i in at[new[r] : new[r] + size[r]].tolist())
            words = {*model.split(run), *([model.restore(run)] if len(run) <= LONGEST else ())}
            extra += [(int(doc[new[r]]), index.setdefault(w, len(index))) for w in sorted(words)]
        if extra:
            more = np.array(extra, np.int64)
            doc, at = np.r_[doc, more[:, 0]], np.r_[at, more[:, 1]]
    return list(index), doc, at, sizes


def feature_counts(labelled: DataFrame, model: LetterModel) -> np.ndarray:
    """For both labels, in how many labelled documents each feature occurs, and at the end how many documents there are."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        for b in small_batches([batch]):
            label = b.column("toxic").to_numpy().astype(np.int64)
            tokens, doc, at, _ = tokens_of(utf8(b.column("text")), shared.value)
            pairs = np.unique(doc * max(1, len(tokens)) + at)
            doc, token = pairs // max(1, len(tokens)), pairs % max(1, len(tokens))
            own = [[f for w in words_of_token(t, shared.value) for f in buckets(w)] for t in tokens]
            n = np.array([len(x) for x in own], np.int64)
            flat = np.array([f for x in own for f in x], np.int64)
            begin = np.r_[0, np.cumsum(n)]
            count = n[token]
            at = np.repeat(begin[token] - np.r_[0, np.cumsum(count)[:-1]] if len(token) else token, count) + np.arange(int(count.sum()))
            seen = np.unique(np.repeat(doc, count) * BUCKETS + flat[at]) if len(at) else at
            sums += np.bincount(label[seen // BUCKETS] * (BUCKETS + 1) + seen % BUCKETS, minlength=len(sums))
            sums[BUCKETS] += int((label == 0).sum())
            sums[2 * BUCKETS + 1] += int((label == 1).sum())

    return total(labelled.select("text", "toxic"), 2 * (BUCKETS + 1), add).reshape(2, -1)


def weights(counts: np.ndarray) -> np.ndarray:
    """The lower end of each feature's log odds for toxic documents, or 0."""
    with_it, of = counts[:, :-1].astype(float), counts[:, -1:].astype(float)
    if not of.all():
        return np.zeros(BUCKETS, np.float32)
    odds = np.log((with_it + 0.5) / (of - with_it + 0.5))
    spread_of = np.sqrt((1 / (with_it + 0.5) + 1 / (of - with_it + 0.5)).sum(0))
    low = odds[1] - odds[0] - CAUTION * spread_of
    return np.where(low >= LEAST, low, 0).astype(np.float32)


def evidence(docs: DataFrame, model: LetterModel, weight: np.ndarray) -> DataFrame:
    """docs without the text, with evidence: the strongest word's weight, the next one's, the sum of the five strongest, and the log of the length."""
    heavy = np.flatnonzero(weight)
    shared = docs.sparkSession.sparkContext.broadcast((model, dict(zip(heavy.tolist(), weight[heavy].tolist(), strict=True))))
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weight = shared.value
        known: dict[bytes, float] = {}

        def weigh(token: bytes) -> float:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            best = known[token] = max((weight.get(f, 0.0) for w in words_of_token(token, model) for f in buckets(w)), default=0.0)
            return best

        for b in small_batches(batches):
            tokens, doc, at, sizes = tokens_of(utf8(b.column("text")), model)
            get = known.get
            of_token = np.array([w if (w := get(t)) is not None else weigh(t) for t in tokens], float)
            strong = np.flatnonzero(of_token[at] > 0) if len(at) else at
            pairs = np.unique(doc[strong] * max(1, len(tokens)) + at[strong])
            doc, found = pairs // max(1, len(tokens)), of_token[pairs % max(1, len(tokens))]
            order = np.lexsort((-found, doc))
            doc, found = doc[order], found[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            x = np.zeros((b.num_rows, 4))
            for k in range(5):
                top = rank == k
                if k < 2:
                    x[doc[top], k] = found[top]
                x[doc[top], 2] += found[top]
            x[:, 3] = np.log1p(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * b.num_rows + 1, 4, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), lists], names=[*(f.name for f in others), "evidence"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(run, f"{kinds}, evidence array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic model, the last for the constant, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id):
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, score, predicted. labels: doc_id and toxic (0 or 1)."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    work = spread(docs.select("doc_id", "text"))
    model = LetterModel(letter_counts(work))
    # Of several labels of one id the commoner counts, toxic if they are even.
    said = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    usable = said.select("doc_id", "toxic", fold("doc_id").alias("fold")).where("fold <> 0")
    n = usable.count()
    if n > MAX_LABELLED:  # a bounded sample: the least hashes of the ids, of about as many
        drawn = usable.withColumn("hash", F.xxhash64("doc_id")).where(F.pmod("hash", F.lit(1 << 20)) <= int((1 << 20) * MAX_LABELLED * 1.1 / n) + 1)
        usable = drawn.orderBy(F.pmod("hash", F.lit(1 << 20)), "hash", "doc_id").limit(MAX_LABELLED).drop("hash")
    labelled = work.join(F.broadcast(usable), "doc_id")
    weight = weights(feature_counts(labelled.where(F.col("fold") < FOLDS - 1), model))
    last = labelled.where(F.col("fold") == FOLDS - 1).select("doc_id", F.xxhash64("text").alias("copy"), "text", "toxic")
    # Repeated documents teach once each, as far as MAX_LABELLED rows go.
    taught = evidence(last, model, weight).orderBy(F.xxhash64("doc_id"), "doc_id", "copy").limit(MAX_LABELLED).select("evidence", "toxic").collect()
    y = np.array([r["toxic"] for r in taught], float)
    if not 0 < y.sum() < len(y):
        scored = work.select("doc_id", F.lit(0.0).alias("score"))
    else:
        w = logistic(np.array([r["evidence"] for r in taught]), y)
        line = F.lit(float(w[-1]))
        for k in range(4):
            line = line + F.col("evidence")[k] * float(w[k])
        scored = evidence(work, model, weight).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Result of op5: a row for each document."""
    return score(docs, labels)
