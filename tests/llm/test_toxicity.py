import numpy as np
import pytest

from orrery.llm import toxicity as X


@pytest.fixture(scope="module")
def tables(spark, data):
    base = data.replace("sf0.001", "sf0.1")  # enough labels to learn from
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


@pytest.fixture(scope="module")
def model(spark):
    text = "the quick idiot and a stupid clown said a moron is pathetic trash but the loser was worthless and they will be all still better " * 50
    return X.LetterModel(X.letter_counts(spark.createDataFrame([(text,)], "text string")))


@pytest.mark.parametrize(("token", "word"), [(b"1d10t", b"idiot"), (b"m0r0n", b"moron"), (b"stupiiiid", b"stupid"), (b"l.o.s.e.r", b"loser"), (b"tr@$h", b"trash"), (b"cl0wn", b"clown"), (b"still", b"still")])
def test_restores(model, token, word):
    assert X.words_of_token(token, model) == [word]


def test_letters_that_stand_alone(model):
    tokens, doc, at, _ = X.tokens_of([b"you i d i o t there", b"a b", b"M 0 R 0 N", b"", b"x"], model)
    said = [{tokens[t] for t in at[doc == d]} for d in range(5)]
    assert b"idiot" in said[0] and b"moron" in said[2] and said[1] == {b"a", b"b"} and said[3] == set()


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = X.query(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    score, toxic = np.array([r["score"] for r in out]), np.array([r["toxic"] for r in out])
    above = (score[toxic == 1][:, None] > score[toxic == 0][None]).mean() + 0.5 * (score[toxic == 1][:, None] == score[toxic == 0][None]).mean()
    assert above > 0.9 and ((score >= 0) & (score <= 1)).all() and all(r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_held_out_labels_teach_nothing(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(X.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r["doc_id"], round(r["score"], 9)) for r in X.query(docs.drop("lang", "source"), x).collect()} for x in (labels, flipped))
    assert a == b


def test_repeated_and_conflicting_labels(spark, tables):
    """A label said twice counts once, and of several the commoner."""
    docs, labels = tables
    few = labels.limit(600).cache()
    noisy = few.unionByName(few).unionByName(few.where("toxic = 1").selectExpr("doc_id", *(["quality"] if "quality" in few.columns else []), "0 AS toxic"))
    some = docs.join(few.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").cache()
    a, b = ({(r["doc_id"], round(r["score"], 9)) for r in X.query(some, x).collect()} for x in (few, noisy.select(few.columns)))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1, 0.1), (1, None, 1, 0.1), (None, "", 1, 0.1), (2, "a " * 30000, 1, 0.1), (3, "i" * 5000, 1, 0.1)], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        out = X.query(docs, own).collect()
        assert len(out) == 5 and all(r["score"] == 0 and r["predicted"] == 0 for r in out)
        assert {r["doc_id"]: r["held_out"] for r in out}[None] is False
    assert X.query(docs.limit(0), labels).count() == 0


def test_runs_of_letters_are_split_into_words(model):
    def said(text):
        tokens, _, at, _ = X.tokens_of([text], model)
        return {tokens[t] for t in at}

    apart = lambda text: b" ".join(bytes([c]) for c in text.replace(b" ", b""))
    assert b"loser" in said(b"a l o s e r") and {b"stupid", b"moron"} <= said(b"s t u p 1 d m 0 r 0 n")
    long = b"they will all be still better and the quick clown was pathetic " * 3 + b"but the worthless idiot said a moron is trash"
    assert set(long.split()) <= said(apart(long))  # all words of a spaced-out sentence of far more than 64 letters
    assert {b"idiot", b"worthless"} <= set(X.words_of_token(b".".join(apart(long).split()), model)) and b"loser" in X.words_of_token(b"thequickclown" * 6 + b"l0ser", model)
    assert len(said(apart(long * 300))) > 10
