import hashlib
import weakref

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm import bpe_automaton as B
from orrery.llm.common import small_batches, table

PATH = P.path("word_bpe_49k.json")
HARD = ["", " ", "aaaaaaa aaaa", "ΑΣΣΑΣ İstanbul ßẞ", "a<|endoftext|>b <|startoftext|><|startoftext|>", "don't I'LL we'Re 12345", "\x00\x1c\x85é é ﷺ ½ Ⅷ", "日本語テキスト 🙂🙂‍", "!!!???...", "a" * 5000, "ab" * 3000, "́́x", "line\r\nline\ttab　wide"]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return B.WordBpe(open(PATH).read())


def same(ours, theirs, text):
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == want
    assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(ours, theirs, text):
    same(ours, theirs, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(ours, theirs, text):
    same(ours, theirs, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeaeiostrn' ", max_size=80))
def test_words(ours, theirs, text):
    same(ours, theirs, text)


def test_small_automata_accept_one_path_a_word():
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "c</w>"), ("ab", "c</w>")]
    symbols = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    vocab = {t: i for i, t in enumerate([*symbols, *dict.fromkeys(x + y for x, y in merges)])}
    automaton = B.MergeAutomaton(vocab, merges, "</w>")

    def plain(word):  # merges one by one, the earliest first
        parts = [*word[:-1], word[-1] + "</w>"]
        for x, y in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (x, y):
                    parts[i : i + 2] = [x + y]
                i += 1
        return [vocab[p] for p in parts]

    import itertools

    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert automaton.encode(word) == plain(word), word


def test_query_over_documents(spark, data, theirs):
    got = {r["doc_id"]: tuple(r)[1:] for r in B.query(table(spark, data, "documents"), PATH).collect()}
    for doc_id, text in table(spark, data, "documents").select("doc_id", "text").collect():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[doc_id] == (len(ids), digest(" ".join(map(str, ids))), digest(theirs.decode(ids, skip_special_tokens=False)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "hi", None)], "doc_id long, text string, ids string")
    assert sorted((r["doc_id"] or 0, r["token_ids"], r["decoded"], r["ids"]) for r in B.encode_decode(docs, PATH).collect())[0][1:3] != ([], "")
    assert B.encode_decode(docs, PATH).where("text IS NULL AND size(token_ids) = 0 AND decoded = ''").count() == 2
    assert B.query(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="exist already"):
        B.encode_decode(docs.withColumnRenamed("ids", "token_ids"), PATH)


def test_tables_go_when_a_worker_turns_to_another_operator():
    kept = weakref.ref(B.compiled(open(PATH).read()))
    assert B.compiled(open(PATH).read()) is kept()
    assert list(small_batches([])) == [] and kept() is None
    kept = weakref.ref(B.compiled(open(PATH).read()))
    assert list(small_batches([], keeps=True)) == [] and kept() is not None
