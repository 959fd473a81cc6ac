"""Robust covariance against all subsets, the one-class machine against a dense dual."""

import itertools

import numpy as np
import pytest

from loomwork.functions.special import chi2_quantile
from loomwork.operators import outliers, robust


def frame(spark, x, schema="id long, a double, b double"):
    return spark.createDataFrame([(i, *[None if v is None else float(v) for v in row]) for i, row in enumerate(x)], schema)


def test_least_determinant_of_all_subsets(spark):
    for seed in (1, 2):
        x = np.random.default_rng(seed).normal(size=(13, 2))
        x[:3] += 8
        h = (13 + 2 + 1) // 2
        scaled = (x - x.mean(0)) / x.std(0)
        least = min(np.linalg.det(np.cov(scaled[list(s)].T, bias=True)) for s in itertools.combinations(range(13), h))
        fit = robust.robust_covariance(frame(spark, x), ["a", "b"])
        assert fit.determinants[-1] == pytest.approx(least, rel=1e-8)


def test_determinants_never_rise_and_planted_outliers_go(spark):
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([5, -2], [[2, 1.5], [1.5, 2]], 3000)
    x[:600] = rng.multivariate_normal([5, 9], [[0.2, 0], [0, 0.2]], 600)  # a fifth of all, which pulls the plain covariance along
    rows = [*x.round(3).tolist(), [None, 1.0], [1.0, float("nan")]]
    d = frame(spark, rows)
    fit = robust.robust_covariance(d, ["a", "b"])
    assert all(b <= a * (1 + 1e-9) for a, b in zip(fit.determinants, fit.determinants[1:])) and len(fit.determinants) > 1
    assert fit.centre == pytest.approx([5, -2], abs=0.15) and fit.covariance == pytest.approx(np.array([[2, 1.5], [1.5, 2]]), abs=0.3)
    got = {r["id"]: (r["distance2"], r["outlier"]) for r in robust.elliptic_flags(d, ["a", "b"], 0.025).select("id", "distance2", "outlier").collect()}
    assert all(got[i][1] == 1 for i in range(600)) and sum(got[i][1] for i in range(600, 3000)) < 0.05 * 2400
    y = np.array(rows[700]) - fit.centre
    assert got[700][0] == pytest.approx(y @ np.linalg.inv(fit.covariance) @ y) and got[700][1] == int(got[700][0] > chi2_quantile(0.975, 2))
    assert got[3000] == (None, None) and got[3001] == (None, None)


def test_ties_and_degenerate_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (300, 2))
    fit = robust.robust_covariance(frame(spark, x), ["a", "b"])
    assert all(b <= a * (1 + 1e-9) for a, b in zip(fit.determinants, fit.determinants[1:]))
    for bad in (x[:3], np.column_stack([np.arange(50), 2 * np.arange(50)])):
        with pytest.raises(ValueError):
            robust.robust_covariance(frame(spark, bad), ["a", "b"])
        assert robust.elliptic_flags(frame(spark, bad), ["a", "b"]).where("outlier is not null").count() == 0
    assert robust.elliptic_flags(frame(spark, x[:0]), ["a", "b"]).count() == 0
    assert robust.one_class_flags(frame(spark, x[:0]), ["a", "b"]).count() == 0
    assert robust.one_class_flags(frame(spark, np.ones((40, 2))), ["a", "b"]).where("outlier = 1").count() == 0


def test_one_class_agrees_with_dense_dual(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (380, 2)), rng.uniform(-6, 6, (20, 2))])
    nu, n = 0.1, len(x)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    k = np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(2))
    alpha = np.full(n, 1 / n)
    for _ in range(20_000):  # pairs that break the optimality most
        g = k @ alpha
        up, down = np.where(alpha < 1 / (nu * n) - 1e-12)[0], np.where(alpha > 1e-12)[0]
        i, j = up[g[up].argmin()], down[g[down].argmax()]
        if g[j] - g[i] < 1e-6:
            break
        t = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), 1 / (nu * n) - alpha[i], alpha[j])
        alpha[i] += t
        alpha[j] -= t
    g = k @ alpha
    dense = g < np.quantile(g, nu)
    out = robust.one_class_flags(frame(spark, [*x.tolist(), [None, 0.0]]), ["a", "b"], nu)
    got = {r["id"]: r["outlier"] for r in out.collect()}
    flags = np.array([got[i] for i in range(n)])
    assert (flags == dense).mean() >= 0.95 and abs(flags.mean() - nu) < 0.01 and got[n] is None
    model = robust.fit_one_class(frame(spark, z), ["a", "b"], nu, 0.5)
    assert model.gaps[-1] <= 1e-3 and len(model.gaps) <= 61


def test_one_class_settles_where_plain_steps_do_not(spark):
    z = np.random.default_rng(5).normal(size=(400, 2))
    z[:20] *= 4
    fit = robust.fit_one_class(frame(spark, z).repartition(2), ["a", "b"], 0.1, 0.5)
    assert fit.gaps[-1] <= 1e-3 and len(fit.gaps) <= 35  # straight steps: 0.0027 after 60


def test_shortest_average_of_corners():
    corners, shares = [np.array([2.0, 0.0])], np.ones(1)
    added = [[0.0, 2.0], [-1.0, 3.0], [1.0, 0.5], [3.0, 3.0]]
    for c in added:
        corners, shares = robust._least_norm(corners, shares, np.array(c))
    ends = [np.array(c) for c in [[2.0, 0.0], *added]]
    least = min(np.linalg.norm(a * (1 - t) + b * t) for a in ends for b in ends for t in np.linspace(0, 1, 2001))
    assert np.linalg.norm(shares @ np.array(corners)) == pytest.approx(least, rel=1e-5) and len(corners) <= 3


def test_all_methods_together(spark):
    x = np.random.default_rng(6).normal(size=(200, 2))
    x[0] = [40, -40]
    out = outliers.detect_outliers(frame(spark, x), "id", ["a", "b"], min_points=4)
    assert {c for c in out.columns if c.startswith("multivariate")} == {f"multivariate_{m}_outlier" for m in outliers.MULTIVARIATE} and len(outliers.UNIVARIATE) + len(outliers.MULTIVARIATE) == 11
    first = out.where("id = 0").first()
    assert all(first[f"multivariate_{m}_outlier"] == 1 for m in outliers.MULTIVARIATE)
