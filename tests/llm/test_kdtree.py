"""Exact top-k search against brute force in plain Python."""

import math
import random

import numpy as np
import pytest

from caseweave.llm import kdtree

VECTORS = "vec_id long, embedding array<float>, shard string, pos int, vec int"


def brute(rows, asked, k):
    """rows: (id, integers); asked: those that are queries."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, v in asked:
        best = sorted(((-dot(v, w), i) for i, w in rows if i != q))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def plain(rows):
    return [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in rows
            if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def found(spark, rows, every, k, shards=0):
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], VECTORS)
    index = kdtree.build_index(kdtree.quantise(df), shards)
    asked = index.where(f"vec_id % {every} = 0").selectExpr("vec_id as query_id", "vec")
    return sorted(tuple(r) for r in kdtree.search(index, asked, k).collect())


@pytest.mark.parametrize("shards", [1, 7])
def test_clusters_and_ties(spark, shards):
    rng = random.Random(shards)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(900)]
    rows += [(900 + i, [0.5] * 6) for i in range(400)]                                  # one vector that a third of the rows have
    assert found(spark, rows, 50, 10, shards) == brute(plain(rows), [r for r in plain(rows) if r[0] % 50 == 0], 10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 0.0]), (None, [9.0, 9.0]), (6, []), (7, [3.0]), (8, [0.0, 0.0, 5.0]),
            (9, [-1e6, 1e6]), (11, [1e-9, -1e-9]), (12, [2.0, 2.0])]
    want = brute(plain(rows), [r for r in plain(rows) if r[0] % 10 == 0], 10)
    assert found(spark, rows, 10, 10) == found(spark, rows, 10, 10, 5) == want
    assert len(want) == 2 * 7                                                           # all, if fewer than ten
    twice = found(spark, [*rows, (12, [2.0, 2.0])], 10, 3)
    assert [(r[2], r[3]) for r in twice if r[0] == 0] == [(9, 1024 * 1024 * 1_000_000), (12, 6 * 1024 * 1024), (12, 6 * 1024 * 1024)]
    assert found(spark, [(1, [1.0])], 10, 3) == [] and found(spark, [(10, [1.0])], 10, 3) == []
    assert found(spark, [], 10, 3) == []
    big = [(0, [1e6, 1.0]), (1, [1e6, 3.0]), (2, [-1e6, 3.0])]                           # beyond what doubles hold exactly
    assert found(spark, big, 10, 3) == brute(plain(big), plain(big)[:1], 3)


def test_tree_prunes_and_first_leaf_gives_a_floor():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-50, 50, (500, 3)) + np.array([900 * i, 0, 0]) for i in range(8)])
    points = points[kdtree.median_order(points)]
    tree = kdtree.Tree(points, np.arange(len(points)), np.ones(len(points), np.int64))
    q = np.array([[3, 1, 1]])
    scores = points @ q[0]
    want = sorted(zip((-scores).tolist(), range(len(points))))[:10]
    assert next(tree.search(q, [-1], [None], 10)) == [(-s, i) for s, i in want]
    few = next(tree.search(q, [-1], [None], 10, leaves=8))
    assert few == [(-s, i) for s, i in want]                                            # best first: a few of 64 leaves are enough
    one = next(tree.search(q, [-1], [None], 10, leaves=1))
    assert one[-1][0] <= -want[-1][0]
    for leaf, child in zip(range(len(tree.a)), tree.child):
        own = points[tree.a[leaf]:tree.b[leaf]]
        assert (tree.low[leaf] == own.min(0)).all() and (tree.high[leaf] == own.max(0)).all()
