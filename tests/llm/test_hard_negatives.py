"""Hard negatives against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import loomwork.llm.hard_negatives as hn
from loomwork.llm.hard_negatives import fit_tree, hard_negatives, leaf_pairs

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    good = {}
    for i, v, l in rows:
        if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault((i, l, tuple(v)), None)
    out = []
    anchors = {}
    for i, l, v in good:
        if i % 5 == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    for a, (al, av) in anchors.items():
        scored = sorted((-int(np.dot(av, v)), i, l) for i, l, v in good if i != a)
        for s, p, _ in [x for x in scored if x[2] == al][:5]:
            fits = [x for x in scored if x[2] != al and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 5 == 0).collect())


@pytest.mark.parametrize("clustered", [False, True])
def test_equals_all_pairs_over_many_leaves(spark, monkeypatch, clustered):
    monkeypatch.setattr(hn, "CANDIDATE_LEAF", 64)
    monkeypatch.setattr(hn, "ANCHOR_LEAF", 8)
    r = np.random.default_rng(1)
    centres = r.normal(0, 40, (12, 6)) if clustered else np.zeros((12, 6))
    rows = [(i, np.floor(centres[i % 12] + r.normal(0, 5, 6)).tolist(), int(r.integers(3))) for i in range(600)]
    rows += [(600 + i, rows[5][1], i % 3) for i in range(200)]  # one vector for a quarter of all: a leaf of many blocks, ties by id
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [2.0, 2.0], 1), (2, [1.0, 1.0], 2), (3, [1.0, 1.0], 2), (3, [1.0, 1.0], 2), (4, [0.0, 0.0], 1), (5, [0.0, 0.0], 2),
        (6, None, 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 2), (10, [-1.0, -2.0], 1), (11, [1.0], 1), (12, [], 1),
        (None, [1.0, 2.0], 1), (14, [1.0, 1.0], None), (15, [3.0, 3.0], 2), (15, [3.0, 2.0], 1), (16, [2.0, 3.0], 2),
    ]
    assert found(spark, rows) == plain([x for x in rows if x[1] is None or len(x[1]) == 2])


def test_nothing_and_one(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, [1.0, 2.0], 1)]) == []


def test_extra_columns_and_large_components(spark):
    rows = [(i, [float(random.Random(i).randint(-(10**6), 10**6)), 70_000.0 * i], i % 2) for i in range(40)]
    got = found(spark, [(*x, "c", 1) for x in rows], SCHEMA + ", id string, leaf int")
    assert got == plain(rows)


def test_bounds_prune_and_lose_nothing():
    """Of clustered points whole node pairs go, and no pair of rows in reach with them."""
    r = np.random.default_rng(2)
    x = (r.normal(0, 50, (16, 8))[r.integers(16, size=2000)] + r.normal(0, 1, (2000, 8))).round()
    c, a = fit_tree(x, len(x), 64), fit_tree(x[::10], 200, 16)
    for t, rows in ((c, x), (a, x[::10])):
        at = t.leaf(rows)
        while True:
            np.maximum.at(t.radii, at, np.linalg.norm(rows - t.centres[at], axis=1))
            np.add.at(t.rows, at, 1)
            if not at.any():
                break
            at = (at - 1) // 2
    least = 20000.0
    pairs = {tuple(p) for p in leaf_pairs(a, c, np.full(len(a.radii), least), np.full(len(a.radii), np.inf))}
    assert 0 < len(pairs) < 0.6 * (1 << a.depth) * (1 << c.depth)
    i, j = np.nonzero(x[::10] @ x.T >= least)
    assert {tuple(p) for p in np.stack([a.leaf(x[::10])[i], c.leaf(x)[j]], 1)} <= pairs
