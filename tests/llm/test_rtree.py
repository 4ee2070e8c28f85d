"""Hard negatives against brute force: ties, copies, odd rows, big numbers, small tiles; and what the boxes spare."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import rtree

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10, scale=256.0):
    fit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    fine = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(fine):
        if not anchor(i):
            continue
        scores = [(-fit(sum(p * q for p, q in zip(v, w, strict=True))), j, e) for b, (j, w, e) in enumerate(fine) if a != b and len(v) == len(w)]
        for s, j, _ in sorted(x for x in scores if x[2] == c)[:positives]:
            far = sorted(x for x in scores if x[2] != c and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(far, 1)]
    return sorted(out)


def got(df, **more):
    return sorted(map(tuple, rtree.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()))


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    out = [(i, (centres[i % 6] + 0.4 * r.normal(size=8)).round(1).tolist(), int(r.integers(4))) for i in range(600)]
    out += [(1000 + i, [0.5] * 8, i % 2) for i in range(200)]  # a quarter of all rows are copies
    out += out[:30] + [(1500, [1.0, 2.0], 0), (1510, [1.0, 2.5], 0), (1511, [0.5, 1.0], 1)]
    return out


@pytest.mark.parametrize("tile", [256, 4096, rtree.TILE])
def test_brute(spark, rows, tile):
    assert got(spark.createDataFrame(rows, SCHEMA), tile=tile) == brute(rows, lambda i: i % 10 == 0)


def test_few_boxes(spark, rows, monkeypatch):
    """More tiles than boxes: runs of tiles share one."""
    monkeypatch.setattr(rtree, "BOXES", 3)
    assert got(spark.createDataFrame(rows, SCHEMA), tile=256) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    big = [(10 * i, [3e9 * (i - 4), 7e8 * i], i % 2) for i in range(9)] + [(10 * i + 100, [3e300, -1e300 * i], i % 2) for i in range(4)]
    odd = [(None, [1.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [float("nan"), 1.0], 0), (40, [float("inf"), 1.0], 0), (50, [], 0), (60, [1.0, 1.0], None), (70, [0.0, 0.0], 0), (70, [0.0, 0.0], 0), (80, [0.0, 0.0], 1), (90, [1e307, 0.0], 1), (-100, [1.0, 1.0], 0)]
    df = spark.createDataFrame(big + odd, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "size", "vector", "tile", "leaf", "anchor", "want", "hash", "scaled")})
    assert got(df) == brute(big + odd, lambda i: i % 10 == 0)
    assert got(df.limit(0)) == [] and got(spark.createDataFrame(odd[:7], SCHEMA)) == []


def test_boxes_spare_rows():
    r = np.random.default_rng(1)
    x = np.floor(256 * (r.normal(size=(40, 16))[r.integers(40, size=8192)] + 0.05 * r.normal(size=(8192, 16))))
    leaves = np.zeros(len(x), np.int64)
    runs = rtree.packed(x)
    assert sorted(np.concatenate(runs).tolist()) == list(range(len(x))) and max(map(len, runs)) <= rtree.LEAF
    for i, run in enumerate(runs):
        leaves[run] = i
    tree = rtree.RTree(x, np.arange(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64), leaves)
    for q in range(0, 1000, 100):
        ids, scores = tree.search(x[q], q, 0, True, [(rtree._LEAST, rtree._MOST)], 5)[0]
        s = x @ x[q]
        s[q] = -np.inf
        assert ids.tolist() == np.lexsort((np.arange(len(x)), -s))[:5].tolist()
    assert tree.opened < 0.2 * 10 * len(x)
