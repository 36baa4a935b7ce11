import random
import re

import numpy as np
import pytest

from orrery.llm import jaccard_join as J
from orrery.llm.common import cut_short, short
from orrery.llm.components import components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=3, percent=90):
    sets = [(i, shingles(t, k)) for i, t in rows]
    lead = {i: i for i, _ in rows if i is not None}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                lead[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def check(spark, rows, k=3, percent=90):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' AS keys", "1 AS n", "2 AS component_id")
    assert sorted((tuple(r) for r in J.join(docs, k, percent).collect()), key=repr) == brute(rows, k, percent)


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent", "size"), [(3, 90, 60), (3, 90, 400), (5, 80, 40), (5, 80, 150)])
def test_near_copies(spark, monkeypatch, k, percent, size):
    rng = random.Random(size)
    out = []
    for _ in range(4):
        out += near_copies(rng, " ".join(f"w{rng.randrange(3000)}" for _ in range(size)), 25, 8)
    monkeypatch.setattr(J, "ENOUGH", rng.choice((-10**9, 100)))
    monkeypatch.setattr(J, "SLICE", rng.choice((7, 2048)))
    monkeypatch.setattr(J, "ALIKE", rng.choice((2, 16, 10**9)))
    common = " ".join(f"c{i}" for i in range(size // 2))
    out += [f"{common} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(size // 3))}" for _ in range(25)]
    rng.shuffle(out)
    check(spark, list(enumerate(out)), k, percent)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "One two three"), (9, "one two three"), (9, "one two three"), (10, "x " * 5000), (11, "x " * 6000), (None, "one two three"), (12, "É a b"), (13, "é a b"), (14, " ".join(str(i) for i in range(9000))), (15, " ".join(str(i) for i in range(9001))), (16, "q r s"), (16, "one two three")]
    check(spark, rows)
    check(spark, [])
    with pytest.raises(ValueError, match="percent"):
        J.join(spark.createDataFrame([], "doc_id long, text string"), 3, 40)


def test_frequent_tokens_are_combined(spark, monkeypatch):
    """With every token frequent, sets are found by combinations alone, long ones and those between two sizes too."""
    rng = random.Random(1)
    out = [t for _ in range(6) for t in near_copies(rng, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice((20, 60, 110, 140, 160, 200, 700)))), 12, 4)]
    monkeypatch.setattr(J, "often", lambda counts: 0)
    check(spark, list(enumerate(out)))


@pytest.mark.parametrize("percent", [60, 80, 90, 99])
@pytest.mark.parametrize("frequent_from", [0, 3, 8, 1000])
def test_linked_sets_share_a_key(percent, frequent_from):
    """Whatever the class of frequent tokens, two sets that link have a key in common, and its places don't rule the pair out."""
    rng = np.random.default_rng(percent + frequent_from)
    count = {}
    sets = []
    for size in (2, 3, 9, 14, 40, 70, 75, 81, 160, 330, 900):
        base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        for _ in range(10):
            changed = rng.permutation(size)[: rng.choice((1, 1, 2, 3, 1 + size // 10))]
            s = base.copy()
            s[changed] = rng.integers(0, 1 << 62, len(changed), dtype=np.uint64)
            sets.append(s)
            for t in s.tolist():
                count[t] = count.get(t, 0) + 1
    keyed = []
    for s in sets:
        n, c = len(s), np.array([count[t] for t in s.tolist()])
        order = np.lexsort((J.mixed(s), c))[: J.prefix(len(s), percent) + J.groups(len(s) * 100 // percent, percent)]
        keys, places = J.signature(s[order], c[order] < frequent_from, n, percent)
        keyed.append((set(s.tolist()), dict(zip(keys.tolist(), [*range(len(keys) - len(places)), *places.tolist()], strict=True))))
        assert len(keys) <= 12 * J.prefix(n, percent) + 4
    linked = 0
    for i, (a, x) in enumerate(keyed):
        for b, y in keyed[:i]:
            if a != b and 100 * len(a & b) >= percent * len(a | b):
                linked += 1
                assert any((100 + percent) * min(len(a) - x[k], len(b) - y[k]) >= percent * (len(a) + len(b)) for k in x.keys() & y.keys())
    assert linked >= 10


def test_documents_have_combinations(spark, data):
    """Of the table's documents some index combinations, long ones among them."""
    rows = J.keyed(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet"), 3, 90).selectExpr("n", "size(places) AS combined").collect()
    print(sum(r["combined"] for r in rows), "combinations")
    assert sum(r["combined"] > 0 for r in rows) >= 100 and any(r["combined"] and r["n"] > 500 for r in rows)


def test_one_of_each(spark):
    docs = spark.createDataFrame([(3, "a b c", 1), (1, "a b c", 2), (1, "a b c", 3), (2, "x y z", 4), (None, "a b c", 5)], "doc_id long, text string, rank int")
    assert sorted(r["doc_id"] or 0 for r in J.one_of_each(docs, 3, 90).collect()) == [0, 1, 2]


def rows_of_joins(spark, known, pattern):
    """Rows that joins of the executions after the first `known` put out, by Spark's own counts."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    done = store.executionsList()
    for execution in (done.apply(i).executionId() for i in range(known, done.size())):
        counts, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(pattern, node.desc()):
                metrics = node.metrics()
                ids = [metrics.apply(i).accumulatorId() for i in range(metrics.size()) if metrics.apply(i).name() == "number of output rows"]
                made += sum(int(counts.apply(i).replace(",", "")) for i in ids if counts.contains(i))
    return made


def test_rounds_read_what_is_left(spark, monkeypatch):
    """Chains that the first round has finished are read by no round but the second, and rounds that change nothing are not repeated."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    done = [f"{words(f'a{k}_', 60)} x{k}_{i}" for k in range(20) for i in range(6)]
    unlike = [f"{words(f'b{k}_', 30)} {words(f'c{j}_', 30)}" for k in range(12) for j in range(4)]
    found = []
    monkeypatch.setattr(J, "chains", lambda *a, f=J.chains: found.append(J.cut(f(*a))) or found[-1])
    monkeypatch.setattr(J, "ENOUGH", -(10**9))
    known = spark._jsparkSession.sharedState().statusStore().executionsCount()
    check(spark, list(enumerate(done + unlike)))
    shared = found[0].where("m > 2").join(spark.createDataFrame([(i, i < len(done)) for i in range(len(done + unlike))], "doc long, done boolean"), "doc")
    rows = {r["done"]: r["count"] for r in shared.groupBy("done").count().collect()}
    assert rows[True] >= 300 and rows[False] >= 48
    assert rows[True] + rows[False] <= rows_of_joins(spark, known, r"Join \[doc#\d+L\], \[doc#\d+L\], LeftOuter") <= rows[True] + 2 * rows[False]


@pytest.mark.parametrize("few", [0, 10, 20_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("orrery.llm.components.FEW", few)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(41)), list(range(100, 130)), [200, 201]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_rows_share_files(spark):
    held = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(5000).selectExpr("id % 700 AS a").distinct()
        for got in (cut_short(rows), short(rows)):
            assert got.rdd.getNumPartitions() <= max(40, 2 * spark.sparkContext.defaultParallelism)
            assert sorted(r["a"] for r in got.collect()) == list(range(700))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
