import re

from orrery.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(AZ))
    hits = [(i, t.label) for t in L.TEMPLATES if t.base for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, template int, label string")
    return [tuple(r) for r in L.query(docs).collect()]


def test_edges_and_brute_force(spark):
    texts = [None, "", "CC BY", "cc by cc by nc", "all RIGHTS reserved. All rights\nreserved", "general public licenſe", "GNU General Public License!", "x " * 20000 + "cc by", "K cc-by É", "all rights all rights reserved"]
    got = {r[0]: r for r in run(spark, [(i, t, "clash", 1, None) for i, t in enumerate(texts)])}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i][1:6] == brute(t), t
        assert set(filter(None, got[i][5].split(","))) <= set(got[i][6].split(",")) and 0 <= got[i][7] <= 1


def test_repeated_null_ids_and_empty(spark):
    assert sorted(run(spark, [(1, "cc by", "", 0, "")] * 3 + [(1, "none", "", 0, ""), (None, "cc by", "", 0, "")]), key=repr) == sorted([(1, 2, 1, 0, 0, "cc-by", "cc-by", 1.0)] * 3 + [(1, 1, 0, None, None, "", "", 0.0), (None, 2, 1, 0, 0, "cc-by", "cc-by", 1.0)], key=repr)
    assert run(spark, []) == []


def test_votes_tolerate_edits(spark):
    phrase = next(t for t in L.TEMPLATES if t.label == "bsd").words
    added = [*phrase[:7], "really", *phrase[7:]]
    replaced = [*phrase[:2], "other", *phrase[3:]]
    half = phrase[: len(phrase) // 2]
    got = {r[0]: r[6] for r in run(spark, [(i, "before " + " ".join(w) + " after", "", 0, "") for i, w in enumerate([phrase, added, replaced, half])])}
    assert got == {0: "bsd", 1: "bsd", 2: "bsd", 3: ""}


def test_work_grows_with_the_text(spark):
    """A text of very many matches: brute force agrees, and ten times the matches take nowhere near a hundred times as long."""
    import time

    took = []
    for n in (2000, 20000):
        text = "all rights reserved and cc by " * n
        at = time.time()
        row = run(spark, [(1, text, "", 0, "")])[0]
        took.append(time.time() - at)
        assert row[1:6] == brute(text)
    assert took[1] < 30 * took[0], took


def brute_row(text):
    """The whole row by the rule of the module's docstring, word by word."""
    words = WORD.findall((text or "").translate(AZ))
    labels, score = set(), 0.0
    for t in L.TEMPLATES:
        k, n, by_diagonal = t.k, len(t.words), {}
        for i in range(len(words) - k + 1):
            for j in range(n - k + 1):
                if words[i : i + k] == t.words[j : j + k]:
                    by_diagonal.setdefault(i - j, set()).add(j)
        spans, chain, last = [], set(), None
        for diagonal in [*sorted(by_diagonal), None]:
            if last is not None and (diagonal is None or k == n or diagonal - last > L.NEAR):
                spans.append(len({p + x for p in chain for x in range(k)}) / n)
                chain = set()
            if diagonal is not None:
                chain, last = chain | by_diagonal[diagonal], diagonal
        for cover in spans:
            if cover >= L.MIN_COVER:
                labels.add(t.label)
                score = max(score, cover)
    return (*brute(text), ",".join(sorted(labels)), score)


def test_whole_rows_equal_brute_force(spark, data):
    """All documents of the table, and texts made of pieces of the templates."""
    import random

    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(L.TEMPLATES).words
            lo = rng.randrange(len(t))
            piece = t[: rng.randint(max(1, len(t) - 3), len(t))] if rng.random() < 0.6 else t[lo:]
            words += [w if rng.random() > 0.05 else "other" for w in piece] + [f"w{rng.randrange(9)}" for _ in range(rng.randrange(6))]
        rows.append((10**6 + i, " ".join(words)))
    got = {r[0]: r[1:] for r in run(spark, [(i, t, "", 0, "") for i, t in rows])}
    for i, t in rows:
        want = brute_row(t)
        assert got[i][:6] == want[:6] and abs(got[i][6] - want[6]) < 1e-9, (i, got[i], want)
    assert sum(bool(r[5]) for r in got.values()) > 60
