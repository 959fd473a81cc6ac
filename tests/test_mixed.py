"""Mixed models against dense likelihoods."""

import math

import numpy as np
import pytest

from loomwork.operators import mixed


def dense(x, y, parts, s2):
    """The log-likelihood of y with the fixed effects at their best, from the whole covariance of all rows."""
    v = s2 * np.eye(len(y)) + sum(parts)
    w = np.linalg.solve(v, np.column_stack([x, y]))
    beta = np.linalg.solve(x.T @ w[:, :-1], x.T @ w[:, -1])
    r = y - x @ beta
    return -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r)), beta, np.linalg.inv(x.T @ w[:, :-1])


def climb(f, at):
    """The best point of f, by steps along each axis and each pair of axes that shrink."""
    best, step = f(at), 0.5
    moves = [np.array(m) for m in np.ndindex(*[3] * len(at)) if 0 < sum(i != 1 for i in m) <= 2]
    while step > 1e-3:
        tried = [(f(at + step * (m - 1)), tuple(at + step * (m - 1))) for m in moves]
        top = max(tried)
        if top[0] > best:
            best, at = top[0], np.array(top[1])
        else:
            step /= 2
    return best, at


def rows_of(seed, slope):
    rng = np.random.default_rng(seed)
    g = rng.choice(14, 90, p=[0.3] + [0.7 / 13] * 13)  # a hot group
    x = rng.normal(1, 1, 90)
    u, s = rng.normal(0, 1.5, 14), rng.normal(0, slope, 14)
    return g, x, 2 + 0.7 * x + u[g] + s[g] * x + rng.normal(0, 1, 90)


@pytest.mark.parametrize("slope", [0.0, 1.5])
def test_one_factor_equals_dense(spark, slope):
    g, x, y = rows_of(3, slope)
    extra = [(None, 1.0, 2.0), (3, None, 1.0), (3, 1.0, None), (3, float("nan"), 1.0)]
    d = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)] + extra, "g int, x double, y double")
    one, z = np.column_stack([np.ones(90), x]), (g[:, None] == g[None, :]).astype(float)
    simple = mixed.mixed_model(d, "y", ["x"], "g")
    f = lambda t: dense(one, y, [math.exp(t[0]) * z], math.exp(t[1]))[0]
    best, _ = climb(f, np.zeros(2))
    assert simple.log_likelihood == pytest.approx(best, abs=1e-4) and simple.n == 90
    assert all(b >= a - 1e-9 for a, b in zip(simple.rounds, simple.rounds[1:]))
    _, beta, cov = dense(one, y, [simple.random[0, 0] * z], simple.residual)
    assert simple.effects == pytest.approx(beta, abs=1e-6) and simple.covariance == pytest.approx(cov, rel=1e-6, abs=1e-9)
    both = mixed.mixed_model(d, "y", ["x"], "g", ["x"])

    def g3(t):
        root = np.array([[math.exp(t[0]), 0], [t[1], math.exp(t[2])]])
        return dense(one, y, [(one @ root @ root.T @ one.T) * z], math.exp(t[3]))[0]

    best, _ = climb(g3, np.array([0.3, 0.0, -1.0, 0.0]))
    assert both.log_likelihood == pytest.approx(best, abs=2e-3) and both.log_likelihood >= simple.log_likelihood - 1e-6
    x2, df, pvalue = mixed.likelihood_ratio(simple, both)
    assert df == 2 and x2 >= 0 and (pvalue < 0.001) == (slope > 0)
    effects = {r["g"]: r["effects"] for r in mixed.random_effects(d, both, "y", ["x"], "g").collect()}
    for k in set(g):
        zk, r = one[g == k], y[g == k] - one[g == k] @ both.effects
        want = both.random @ zk.T @ np.linalg.solve(both.residual * np.eye(len(zk)) + zk @ both.random @ zk.T, r)
        assert effects[k] == pytest.approx(want, abs=1e-6)


def test_no_group_variance(spark):
    same = spark.createDataFrame([(i % 40, float(i % 4)) for i in range(400)], "g int, y double")  # all rows of a group are equal
    with pytest.raises(ValueError, match="no residual"):
        mixed.mixed_model(same, "y", [], "g")
    flat = spark.createDataFrame([(i % 5, float(i // 5)) for i in range(50)], "g int, y double")
    fit = mixed.mixed_model(flat, "y", [], "g")
    assert fit.random[0, 0] < 1e-3 and fit.residual == pytest.approx(np.var(np.arange(10)), rel=1e-3)


def test_crossed_factors_equal_dense(spark):
    rng = np.random.default_rng(7)
    g, h, x = rng.integers(0, 12, 90), rng.integers(0, 5, 90), rng.normal(0, 1, 90)
    y = 1 + 0.5 * x + rng.normal(0, 1, 12)[g] + rng.normal(0, 0.8, 5)[h] + rng.normal(0, 1, 90)
    d = spark.createDataFrame([(int(a), f"h{b}", float(c), float(e)) for a, b, c, e in zip(g, h, x, y)] + [(1, None, 1.0, 1.0)], "g int, h string, x double, y double")
    fit = mixed.crossed_model(d, "y", ["x"], "g", "h")
    one = np.column_stack([np.ones(90), x])
    zg, zh = ((a[:, None] == a[None, :]).astype(float) for a in (g, h))
    best, _ = climb(lambda t: dense(one, y, [math.exp(t[0]) * zg, math.exp(t[1]) * zh], math.exp(t[2]))[0], np.zeros(3))
    assert fit.log_likelihood == pytest.approx(best, abs=1e-4)
    _, beta, cov = dense(one, y, [fit.random[0, 0] * zg, fit.second * zh], fit.residual)
    assert fit.effects == pytest.approx(beta, abs=1e-5) and fit.covariance == pytest.approx(cov, rel=1e-4)
    assert all(b >= a for a, b in zip(fit.rounds, fit.rounds[1:]))


def test_named_errors(spark):
    none = spark.createDataFrame([], "g int, h int, x double, y double")
    with pytest.raises(ValueError, match="too few"):
        mixed.mixed_model(none, "y", ["x"], "g")
    with pytest.raises(ValueError, match="no complete"):
        mixed.crossed_model(none, "y", ["x"], "g", "h")
    twice = spark.createDataFrame([(i % 3, float(i), 2.0 * i, float(i * i % 7)) for i in range(30)], "g int, a double, b double, y double")
    with pytest.raises(ValueError, match="depend"):
        mixed.mixed_model(twice, "y", ["a", "b"], "g")
