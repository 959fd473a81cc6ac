"""Chained-equation imputation and Kendall's tau against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import ordered
from loomwork.operators import association, imputing


def plain_donors(rows, k):
    """The sorted values of the k rows with values that are nearest, in the order of (at, id)."""
    known = sorted((at, i, v) for i, at, v in rows if v is not None)
    out = {}
    for i, at, v in rows:
        if v is None:
            near = sorted((abs(at - a), r, w) for r, (a, _, w) in enumerate(known))[:k]
            out[i] = [w for _, _, w in near]
    return out


@pytest.mark.parametrize("few", [200_000, 10])
def test_donors_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW_ROWS", few)
    rng = random.Random(1)
    rows = [(i, rng.random() * 10, float(i) if rng.random() < 0.6 else None) for i in range(300)]
    want = plain_donors(rows, 4)
    d = spark.createDataFrame(rows, "id long, at double, value double")
    chosen = {s: {r["id"]: r["value"] for r in imputing.nearest_donors(d, 4, s).collect()} for s in (1, 2)}
    for got in chosen.values():
        assert set(got) == set(want) and all(got[i] in want[i] for i in want)
    assert chosen[1] != chosen[2]
    one = {r["id"]: r["value"] for r in imputing.nearest_donors(d, 1, 3).collect()}
    assert one == {i: w[0] for i, w in want.items()}
    assert {r["value"] for r in imputing.nearest_donors(d.where("value is null or id < 2"), 9, 3).collect()} <= {float(i) for i in range(2)}
    assert imputing.nearest_donors(d.where("value is null"), 3, 1).count() == 0


def test_regression_and_draw(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = 1 + 2 * x[:, 0] - 3 * x[:, 1] + 0.1 * rng.normal(size=400)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fitted, drawn = imputing.fit_draw(d, "y", ["a", "b"], np.random.default_rng(3))
    dense = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert fitted == pytest.approx(dense, abs=1e-3) and 0 < np.abs(drawn - fitted).max() < 0.05
    assert imputing.fit_draw(d.limit(0), "y", ["a"], None) is None


def test_chained_imputation(spark):
    """Imputed values are observed ones, near the truth where columns depend on each other; the same on each run; nothing else changes."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        a = rng.random() * 10
        rows.append((i, a, 2 * a + rng.random(), 100 - a, "t"))
    holes = [(i, None if i % 7 == 0 else a, None if i % 5 == 1 else b, c if i % 11 else float("nan"), t) for i, a, b, c, t in rows]
    d = spark.createDataFrame(holes, "k long, a double, b double, c double, t string").withColumn("gone", F.lit(None).cast("double"))
    out = imputing.impute_chained(d, "k", ["a", "b", "c", "gone"], rounds=2)
    assert out.columns == d.columns
    got = {r["k"]: r for r in out.collect()}
    again = {r["k"]: r for r in imputing.impute_chained(d.repartition(3), "k", ["a", "b", "c", "gone"], rounds=2).collect()}
    assert got == again and len(got) == 400
    seen = {c: {h[j] for h in holes if h[j] is not None and h[j] == h[j]} for j, c in ((1, "a"), (2, "b"), (3, "c"))}
    for h, r in zip(holes, rows):
        g = got[h[0]]
        assert g["gone"] is None and g["t"] == "t"
        for j, c in ((1, "a"), (2, "b"), (3, "c")):
            if h[j] is None or h[j] != h[j]:
                assert g[c] in seen[c]
                if sum(x is None or x != x for x in h[1:4]) == 1:
                    assert abs(g[c] - r[j]) < 1.5
            else:
                assert g[c] == h[j]
    whole = d.select("k", "t").withColumn("x", F.lit(1.0))
    assert imputing.impute_chained(whole, "k", ["x"]).where("x = 1").count() == 400
    assert imputing.impute_chained(d.limit(0), "k", ["a", "b"]).count() == 0


def test_inversions():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 64, 301):
        x = rng.integers(0, 20, n)
        block = np.sort(rng.integers(0, 5, n))
        assert association.inversions(x) == sum(a > b for a, b in itertools.combinations(x.tolist(), 2))
        assert association.inversions(x, block) == sum(a > b and p != q for (a, p), (b, q) in itertools.combinations(list(zip(x.tolist(), block.tolist())), 2))


@pytest.mark.parametrize("ranges", [4, 256])
def test_tau_equals_all_pairs(spark, monkeypatch, ranges):
    monkeypatch.setattr(association, "RANGES", ranges)
    rng = random.Random(6)
    rows = [(float(rng.choice([0, 0, 0, rng.randint(0, 40)])), rng.choice([5.0, rng.random(), float(rng.randint(0, 3))])) for _ in range(500)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0)]
    got = association.kendall_tau(spark.createDataFrame(rows, "a double, b double"), "a", "b")
    known = rows[:500]
    s = [((p[0] > q[0]) - (p[0] < q[0])) * ((p[1] > q[1]) - (p[1] < q[1])) for p, q in itertools.combinations(known, 2)]
    tx, ty = (sum(p[k] == q[k] for p, q in itertools.combinations(known, 2)) for k in (0, 1))
    n0 = len(s)
    assert (got["n"], got["concordant"], got["discordant"]) == (500, s.count(1), s.count(-1))
    assert got["tau"] == pytest.approx(sum(s) / ((n0 - tx) * (n0 - ty)) ** 0.5)


def test_tau_edges(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0)] * 5, "a double, b double, c double")
    assert association.kendall_tau(d, "a", "b")["tau"] is None and association.kendall_tau(d.limit(0), "a", "b") == {"n": 0, "concordant": 0, "discordant": 0, "tau": None}
    e = spark.createDataFrame([(i, -i, (i * 7) % 30) for i in range(30)], "a int, b int, c int")
    assert association.redundant_by_tau(e, ["a", "b", "c"], 0.99) == ["b"]
    assert [(r["x"], r["y"], round(r["tau"], 6)) for r in association.kendall_matrix(e, ["a", "b"]).collect()] == [("a", "b", -1.0)]


def test_donors_across_ranges_with_the_windows_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 40)) if i % 4 else 7.0, None if i % 3 or 150 < i < 250 else float(i)) for i in range(300)]
    known = sorted((at, i, v) for i, at, v in rows if v is not None)
    want = {}
    for i, at, v in rows:
        if v is None:
            k = sum(x[:2] < (at, i) for x in known)
            near = [(abs(at - known[r][0]), r, known[r][2]) for r in range(max(0, k - 3), min(len(known), k + 3))]
            want[i] = {x[2] for x in sorted(near)[:3]}
    d = spark.createDataFrame(rows, "id long, at double, value double")
    got = {}
    for few in (1000, 10):
        monkeypatch.setattr(ordered, "FEW_ROWS", few)
        found = imputing.nearest_donors(d, 3, 1)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() or few == 10  # no row is spread over its donors
        got[few] = {r["id"]: r["value"] for r in found.collect()}
        assert got[few].keys() == want.keys() and all(v in want[i] for i, v in got[few].items())
    assert got[10] == got[1000]
