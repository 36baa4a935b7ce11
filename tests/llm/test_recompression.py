import hashlib
import random
import re

import pytest

from orrery.llm import recompression as R

words = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute(rows, width):
    first = {}
    for i, t in rows:
        w = words(t or "")
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t or "")
        gone = set()
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, width=R.WIDTH):
    got = sorted((tuple(r) for r in R.query(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()), key=repr)
    assert got == brute(rows, width)


def texts(seed, n, alphabet, pieces):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(3, 90))) for _ in range(pieces)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        out.append(rng.choice([" ", "\n", " \t"]).join(parts))
    return out


def test_random_texts(spark):
    for seed, alphabet in enumerate((["a", "b"], ["a"], [f"w{i}" for i in range(30)], [f"w{i}" for i in range(5000)])):
        check(spark, [(i * 3 % 101, t) for i, t in enumerate(texts(seed, 60, alphabet, 8))], 12 if seed < 2 else 50)


@pytest.mark.parametrize("width", [1, 63, 64, 100, 300])
def test_other_widths(spark, width):
    own = texts(width, 60, [f"w{i}" for i in range(40)], 8) + texts(width, 20, ["a", "b"], 5)
    rng = random.Random(width)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(3 * width))
    check(spark, [(i, t) for i, t in enumerate([*own, f"x {shared} y", f"{shared} z", shared[5:]])], width)


def test_width_out_of_range(spark):
    for width in (0, R.RANGE):
        with pytest.raises(ValueError, match="width"):
            R.query(spark.createDataFrame([], "doc_id long, text string"), width)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    run, pair = "x " * 400, "x y " * 300
    rows = [(1, passage), (2, passage), (2, passage), (None, passage), (3, None), (4, ""), (5, run), (6, "z " + run), (7, pair), (8, pair + "q"), (9, " ".join(passage.split()[:49])), (10, "a b " + passage + "\r\n\x0bé " + passage), (11, " ".join(passage.split()[5:55])), (12, "w " * 30000), (13, "w " * 30001)]
    check(spark, rows)
    check(spark, [])


def test_other_columns_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage, "a", 1), (2, "b " + passage, None, 2)], "doc_id long, text string, rest string, copy int")
    out = {r["doc_id"]: (r["kept_text"], r["rest"], r["copy"], r["text"]) for r in R.dedup(docs).collect()}
    assert out == {1: (passage, "a", 1, passage), 2: ("b", None, 2, "b " + passage)}


def test_equal_substrings_get_equal_symbols():
    import numpy as np

    from orrery.llm.common import named_words

    rng = random.Random(5)
    inside = " ".join(rng.choice("abcdefgh") for _ in range(200))
    names, starts = named_words([(p + " " + inside + " " + q).encode() for p, q in (("a b c", "d"), ("h", "a b"))])
    for sym, lo, hi in R.levels(names, starts):
        seen = []
        for d, off in ((0, 3), (1, 1)):
            begin = starts[d] + off
            inner = (lo >= begin) & (hi <= begin + 200)
            seen.append({(int(s), int(a - begin), int(z - begin)) for s, a, z in zip(sym[inner], lo[inner], hi[inner], strict=True)})
        assert seen[0] == seen[1] and seen[0]
    assert np.all(np.diff(lo) >= 0) and np.all(np.diff(hi) >= 0)
