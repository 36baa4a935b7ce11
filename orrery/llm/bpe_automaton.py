"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts just those sequences that byte-pair encoding makes. It starts as one state on which
every base symbol loops. Each merge (u, v) -> uv then applies one gadget, in the order of the merges:

* wherever u leads to a state that reads v, u is led to a copy of that state without v;
* wherever u can be read, uv can be read now, and it leads to where v led.

All arcs labelled t lead to one state at any time, so a state is named by the token last read, and the automaton is deterministic. A copy is kept as its difference: the
state of its token's right part, as it was when the token was made, less the arcs that later gadgets took away. When all gadgets are done, the differences are compiled to
two tables: for each state the arcs that it and those it was copied from lost, with the times up to which they count; for each token the arcs that it grew from, with
the times at which it did. A transition exists unless one meets the other in time: a few lookups. The tables have a row for each token and an entry for each merge (some MB), are built once
in a worker, go when it turns to another operator, and never change while it encodes.

Each beginning of a pre-split word is spelled by exactly one accepted sequence, as BPE is a function; so each place of it is reached by exactly one token, the one that the state at
the token's start reads. Encoding reads the letters once by a matching automaton (pyahocorasick), which tells the tokens that may end at each place; the tables tell which of them does. Nothing is
tried twice or taken back. Decoding emits the labels of the arcs.

Defined cases: a null text gives no tokens and the empty text; an empty table gives an empty result; repeated rows are encoded each
on its own; other columns pass through unchanged, and a clashing output name raises an error.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import give_back, keep, need, small_batches, spread

NEVER = 1 << 60
#: What stands for the end of a word among its letters.
END = "\x00"
#: Words whose tokens a task keeps: those of the last half as many new ones, and those used since then.
CACHE_ENTRIES = 260_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """A deterministic automaton over tokens, made from an ordered list of merges by one gadget each."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix = suffix
        self.labels = {i: t for t, i in vocab.items()}
        made = {a + b for a, b in merges}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.cuts: dict[int, dict[int, int]] = {}
        self.readable = {t: i for t, i in vocab.items() if t not in made}
        for when, (a, b) in enumerate(merges):
            self._gadget(when, vocab[a], vocab[b], vocab[a + b], a + b)
        self._compile()
        plain = {t: t.removesuffix(suffix) for t in self.readable}
        # Reading letters: which tokens end at each place, the longest first. The word's end is a letter of its own.
        self.end = END if suffix else ""
        self.letters = ahocorasick.Automaton()
        for t, i in self.readable.items():
            self.letters.add_word(plain[t] + END if suffix and t.endswith(suffix) else t, i)
        self.letters.make_automaton()
        self.sizes = {i: len(plain[t]) + (bool(suffix) and t.endswith(suffix)) for t, i in self.readable.items()}
        # What the tables were made from isn't needed any more.
        del self.left, self.right, self.born, self.cuts, self.readable

    def _gadget(self, when: int, u: int, v: int, uv: int, label: str) -> None:
        if not self._reads(u, v):  # no state reads u and then v: the merge never applies
            return
        self.cuts.setdefault(u, {})[v] = when
        self.left[uv], self.right[uv], self.born[uv] = u, v, when
        self.readable[label] = uv

    def _reads(self, state: int, token: int) -> bool:
        """Whether the state after one token has an arc for the next, from the differences that the gadgets left."""
        until = NEVER
        while True:
            cuts = self.cuts.get(state)
            if cuts:
                arc, made = token, NEVER
                while True:
                    cut = cuts.get(arc)
                    if cut is not None and cut < until and cut <= made:
                        return False
                    if arc not in self.left:
                        break
                    made, arc = self.born[arc], self.left[arc]
            if state not in self.right:
                return True
            until, state = self.born[state], self.right[state]

    def _compile(self) -> None:
        """The tables of transitions: of each state, the arcs lost by it and by what it was copied from, and of each token, the arcs that it grew from."""
        self.lost: dict[int, tuple[tuple[dict[int, int], int], ...]] = {}
        self.grown: dict[int, tuple[tuple[int, int], ...]] = {}
        for token in self.readable.values():
            rows, state, until = [], token, NEVER
            while True:
                cuts = self.cuts.get(state)
                if cuts and min(cuts.values()) < until:
                    rows.append((cuts, until))
                if state not in self.right:
                    break
                until, state = self.born[state], self.right[state]
            self.lost[token] = tuple(rows)
            arcs, arc, made = [], token, NEVER
            while True:
                arcs.append((arc, made))
                if arc not in self.left:
                    break
                made, arc = self.born[arc], self.left[arc]
            self.grown[token] = tuple(arcs)

    def step(self, state: int, token: int) -> bool:
        """Whether the state after one token reads another, by the tables; state -1 is the start, which reads all."""
        if state < 0:
            return True
        grown = self.grown[token]
        for cuts, until in self.lost[state]:
            for arc, made in grown:
                cut = cuts.get(arc)
                if cut is not None and cut < until and cut <= made:
                    return False
        return True

    def encode(self, word: str) -> list[int]:
        """The tokens of one pre-split word, given in byte letters."""
        if not word:
            return []
        word += self.end
        n, sizes, lost, grown = len(word), self.sizes, self.lost, self.grown
        reached = [-1] * (n + 1)  # the token that ends at each place; only one can
        for at, token in self.letters.iter(word):
            if reached[at + 1] < 0:
                start = at + 1 - sizes[token]
                if start:
                    state = reached[start]
                    if state < 0:
                        continue  # no sequence of tokens spells that beginning
                    for cuts, until in lost[state]:  # as step(), in place
                        for arc, made in grown[token]:
                            if arc in cuts and cuts[arc] < until and cuts[arc] <= made:
                                break
                        else:
                            continue
                        break
                    else:
                        reached[at + 1] = token
                else:  # the start reads all tokens
                    reached[at + 1] = token
        if reached[n] < 0:
            raise LookupError(f"the vocabulary can't spell {word.removesuffix(END)!r}")
        path = []
        while n:
            path.append(reached[n])
            n -= sizes[path[-1]]
        return path[::-1]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by one space as a tokenizer without a decoder joins them."""
        return " ".join(map(self.labels.__getitem__, ids))


class WordBpe:
    """A whole tokenizer of the kind "normalise, pre-split, byte letters, BPE with word ends", read from its JSON description."""

    def __init__(self, description: str) -> None:
        spec = json.loads(description)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("this description needs steps that are not built")
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.labels |= {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self._letters = dict(enumerate(byte_letters()))
        self._assigned: set[str] = set()
        self._description = description
        self._seen: dict[str, list[int]] = {}
        self._older: dict[str, list[int]] = {}

    def forget(self) -> None:
        """Empty the caches: a worker that lives on does other work, too."""
        self._seen, self._older = {}, {}
        self._assigned = set()

    def _has_unassigned(self, text: str) -> bool:
        """Whether a text has characters that were not assigned when this Python's tables were made."""
        new = set(text) - self._assigned
        bad = {c for c in new if unicodedata.category(c) == "Cn"}
        self._assigned |= new - bad
        return bool(bad)

    def _by_library(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """Pre-split words in byte letters, by the library's own normaliser and pre-splitter."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(self._description)
        return own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))

    def _word(self, word: str) -> list[int]:
        """A word's tokens; short words' are kept for a while."""
        ids = self._older.get(word)
        if ids is None:
            ids = self.automaton.encode(word.encode().decode("latin-1").translate(self._letters))
        if len(word) < 48:
            if len(self._seen) >= CACHE_ENTRIES // 2:
                self._seen, self._older = {}, self._seen
            self._seen[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        special = self.special
        for part in self._special.split(text) if self._special and any(s in text for s in special) else [text]:
            if part in special:
                ids.append(special[part])
                continue
            if not part.isascii():
                if self._has_unassigned(part):  # the libraries' character tables are of different age
                    ids += [i for piece, _ in self._by_library(part) for i in self.automaton.encode(piece)]
                    continue
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")  # capital sigma, which lower() treats by its place
            words = self._words(part.lower())
            found = list(map(self._seen.get, words))
            at = -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    found[at] = self._seen.get(words[at]) or self._word(words[at])
            except ValueError:  # no word is left without its tokens
                pass
            ids.extend(chain.from_iterable(found))
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids)


def compiled(description: str) -> WordBpe:
    """The tokenizer of a description, compiled once in each worker and kept while its tasks are of this operator."""
    return keep(("bpe", hash(description)), lambda: WordBpe(description))


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the token ids of each whole text and, unless decoded is None, the text that the ids decode to.

    tokenizer_path: a tokenizer description on the driver; it is sent to the executors, whose size (under 2 MB) doesn't grow with the data.
    Peak memory is one Arrow batch and a cache of CACHE_ENTRIES words; a row needs no other row, so nothing is shuffled.
    """
    need(docs, text)
    new = [ids] + ([decoded] if decoded else [])
    if clash := [n for n in new if n in docs.columns]:
        raise ValueError(f"columns {clash} exist already")
    with open(tokenizer_path, encoding="utf-8") as f:
        description = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(description.value)
        for batch in small_batches(batches, keeps=True):
            tokens = [tokenizer.encode(t.as_py() or "") for t in batch.column(text)]
            columns = [*batch.columns, pa.array(tokens, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array([tokenizer.decode(x) for x in tokens], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])
        tokenizer.forget()
        give_back()

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> list:
    """The columns n_tokens, ids_sha256 and decoded_sha256 of an encode_decode() result."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Result of op6: a row for each document."""
    out = encode_decode(spread(docs.select("doc_id", "text")), tokenizer_path)
    return out.select("doc_id", *digests(out))
