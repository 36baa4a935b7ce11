import hashlib
import re

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from orrery.llm import decontamination, language_id
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_recompression import words


def dedup(rows, width=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < i for k in range(s, s + width)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def test_stages_against_brute_force(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rejected = {r["doc_id"] for r in language_id.query(docs).where("rejected").collect()}
    rows = [(i, t) for i, t in rows if i not in rejected]
    least = {i: c for i, _, c in groups(rows, 5, 80)}
    rows = dedup([(i, t) for i, t in rows if least[i] == i])
    middle = spark.createDataFrame(rows, "doc_id long, text string")
    leaked = {r["doc_id"] for r in decontamination.query(middle, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    plain = {i: " ".join(re.findall(r"[^\W_]+", t.lower())) for i, t in rows}
    assert {i for i, t in plain.items() if any(x in t for x in items)} <= leaked
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        if i not in leaked:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            want[i] = (t, ids, len(ids), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["text"], r["token_ids"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want


def test_stages_return_documents(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)


ODD = {  # which rows each stage keeps, by their place
    "language_id": [1, 3, 4, 5, 6],  # those without letters are rejected
    "jaccard_join": [0, 1, 2, 3, 5],  # a repeated row and its near copy: one stays; rows without an id or text stay
    "substring_dedup": [0, 1, 2, 3, 4, 5, 6],
    "decontamination": [0, 1, 2, 3, 4, 5, 6],
    "bpe": [0, 1, 2, 3, 4, 5, 6],
}


def test_stages_on_odd_rows(spark, data):
    """Null ids and texts, repeated rows, a very long text, columns with names that operators use, and empty tables: each stage keeps the rows that it says, as they were."""
    long = " ".join(f"word{i % 5000}" for i in range(60000))
    rows = [(1, None, None, None, None, 7, "x", "y", "z"), (None, "some words here", "en", None, 3, 7, "x", "y", "z"), (2, "", "en", "s", 0, 7, "x", "y", "z"), (3, "some words here", "en", "s", 15, 7, "x", "y", "z"), (3, "some words here", "en", "s", 15, 7, "x", "y", "z"), (4, long, "en", "s", 1, 7, "x", "y", "z"), (5, long + " end", "en", "s", 1, 7, "x", "y", "z")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept_text string, rest string, token_ids string"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, kinds), data)
        kept = [rows[i] for i in ODD[name]]
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        if name == "substring_dedup":
            kept = [r if r[0] != 5 else (5, "end") for r in kept]
        assert got == sorted(((r[0], r[1]) for r in kept), key=repr), name
        if name != "bpe":
            assert out.columns == [x.split()[0] for x in kinds.split(", ")], name
        assert {r["rest"] for r in out.collect()} == {"y"} and {r["n_words"] for r in out.collect()} == {7}
        assert stage(spark, spark.createDataFrame([], kinds), data).count() == 0, name
