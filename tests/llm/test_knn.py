import math
import random

import pytest

from orrery.llm import voronoi_knn as V


def brute(rows, k=5, every=50, scale=256):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in fine:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in fine if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


def run(spark, rows, **more):
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS id", "'x' AS vec", "2 AS cell")
    return {tuple(r) for r in V.search(data, **more).collect()}


@pytest.mark.parametrize("clustered", [False, True])
def test_brute_force_with_small_blocks(spark, clustered):
    rng = random.Random(clustered)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [rng.gauss(c, 0.2 if clustered else 3) for c in rng.choice(centres)]) for i in range(600)]
    assert run(spark, rows, every=7, pivots=8, block=10, slice_=50) == brute(rows, every=7)


def test_ties_one_common_vector_and_bad_rows(spark):
    rows = [(i, [0.5, 0.5]) for i in range(120)] + [(i, [0.01 * i, -0.3]) for i in range(120, 260)]
    rows += [(1000, None), (1050, []), (1100, [float("nan"), 1.0]), (1150, [float("inf"), 1.0]), (1200, [None, 1.0]), (None, [1.0, 1.0]), (1250, [1e6, -1e6]), (1300, [1e9, 1e9]), (1350, [0.0, 0.0])]
    assert run(spark, rows, block=2, slice_=30) == brute(rows)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [2.0**30]), (1, [2.0**25]), (2, [-(2.0**25)])]
    with pytest.raises(Exception, match="don't fit 64 bits"):
        run(spark, rows)
    assert run(spark, [(0, [2.0**22]), (1, [2.0**24]), (2, [-(2.0**24)])]) == {(0, 1, 1, 2**62), (0, 2, 2, -(2**62))}


def test_few_rows(spark):
    assert run(spark, []) == set() and run(spark, [(1, [1.0])]) == set() and run(spark, [(0, [1.0])]) == set()
    assert run(spark, [(0, [1.0]), (3, [-1.0])]) == {(0, 1, 3, -65536)}


def test_queries_with_repeated_ids(spark):
    rng = random.Random(5)
    rows = [(50, [4.0, 0.1])] * 6 + [(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(1, 30)]  # a pivot each, so the query's own copies are its cell
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in V.search(data).collect()]
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    q = fine[0][1]
    found = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in fine if i != 50)[:5]
    assert sorted(got) == [(50, r + 1, i, -s) for r, (s, i) in enumerate(found)]
