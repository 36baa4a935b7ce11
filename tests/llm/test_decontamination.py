import random

from orrery.llm import decontamination as D


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, names int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


def test_passages_and_substitutions(spark):
    rng = random.Random(3)
    own = [words(rng, rng.randint(15, 60)) for _ in range(12)]
    rows, want = [], set()
    for d in range(60):
        body = words(rng, 200)
        if d % 3 == 0:
            k = rng.randrange(12)
            passage = list(own[k])
            if d % 2:  # one word in eight is replaced
                for j in range(4, len(passage), 8):
                    passage[j] = "changed"
            body[50:50] = passage
            want.add((d, k))
        rows.append((d, (" ".join(body)).upper() if d % 5 == 0 else ", ".join(body), "x", 1))
    bench = items(spark, [(k, " ".join(w), 1) for k, w in enumerate(own)])
    found = D.query(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert sorted(r["doc_id"] for r in D.clean(docs(spark, rows), bench).collect()) == sorted(set(range(60)) - {d for d, _ in want})


def test_brute_force_over_tables(spark, data, duck):
    import re

    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    own = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    want = {(d, i) for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall() for i, u in own if plain(u) in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in D.query(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert want <= got and len(got - want) <= 1


def test_edges(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, None, "", 0), (2, "", "", 0), (None, passage, "", 0), (None, "fine", "", 0), (3, passage, "", 0), (3, passage, "", 0), (4, "n " * 20000 + passage, "", 0), (5, " ".join(passage.split()[:9]), "", 0)]
    bench = items(spark, [(7, passage, 0), (7, passage, 0), (None, passage, 0), (8, None, 0), (9, "too short", 0)])
    for limit in (D.MAX_BROADCAST, 0):  # by broadcast, and dealt by salted hash
        monkeypatch.setattr(D, "MAX_BROADCAST", limit)
        found = D.query(docs(spark, rows), bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d in (None, 3, 4) for i in (7, None)}
        assert {r["doc_start"] for r in found} == {0, 20000} and {r["n_words"] for r in found} == {30}
        left = D.clean(docs(spark, rows), bench).collect()
        assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in left) == [(0, 4), (1, 0), (2, 0), (5, 26)]
    assert D.query(docs(spark, []), bench).count() == 0
    assert D.clean(docs(spark, rows), bench.limit(0)).count() == len(rows)


def accepted(doc, item, window=D.WINDOW, similarity=D.SIMILARITY):
    """Brute force: whether some window of the item agrees enough at some place of the document."""
    w = min(window, len(item))
    if len(item) < D.LEAST:
        return doc == item
    return any(sum(x == y for x, y in zip(item[j : j + w], doc[i : i + w], strict=False)) >= similarity * w - 1e-9 for j in range(len(item) - w + 1) for i in range(len(doc) - w + 1))


def test_replaced_words_at_every_length(spark):
    """Items of every length with as many words replaced as the rule allows, at all places and one more than it allows: exactly what brute force finds."""
    from itertools import combinations

    rng = random.Random(5)
    rows, bench, want, doc = [], [], set(), 0
    for length in range(1, 16):
        item = words(rng, length)
        bench.append((length, " ".join(item), 0))
        allowed = min(length, D.WINDOW) - int(-(-D.SIMILARITY * min(length, D.WINDOW) // 1)) if length >= D.LEAST else 0
        for n in (0, allowed, allowed + 1):
            for places in rng.sample(list(combinations(range(length), min(n, length))), k=min(25, len(list(combinations(range(length), min(n, length)))))):
                passage = [f"new{k}" if k in places else w for k, w in enumerate(item)]
                for body in (passage, [*words(rng, 30), *passage, *words(rng, 30)]):
                    rows.append((doc, " ".join(body), "", 0))
                    if accepted(body, item):
                        want.add((doc, length))
                    doc += 1
    found = {(r["doc_id"], r["item_id"]) for r in D.query(docs(spark, rows), items(spark, bench)).collect()}
    assert found == want and len(want) > 400


def test_one_row_for_a_diagonal(spark):
    """Two stretches of one item on one diagonal give one row, the longest. Its first window of 13 begins two words early, as 11 equal ones are enough."""
    rng = random.Random(6)
    item = words(rng, 200)
    body = [*item[:30], *words(rng, 100), *item[130:200]]
    found = D.query(docs(spark, [(1, " ".join(body), "", 0)]), items(spark, [(1, " ".join(item), 0)])).collect()
    assert [(r["doc_start"], r["item_start"], r["n_words"], r["n_same"]) for r in found] == [(128, 128, 72, 70)]
