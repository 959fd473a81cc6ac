"""Series in blocks, categories of any number, and the figures of empty, constant and exact tables."""

import math

import numpy as np
import pytest

from loomwork.operators import profiling, statistics, timeseries


def test_smoothing_in_blocks_equals_one_block(spark, monkeypatch):
    r = np.random.default_rng(4)
    values = np.cumsum(r.normal(size=1400)) + 50
    rows = [(s, i, float(v)) for s, n in (("a", 1400), (None, 903), ("short", 6)) for i, v in enumerate(values[:n])]
    d = spark.createDataFrame([*rows, ("a", 5000, None), ("a", None, 1.0)], "s string, t int, x double")
    whole = {(r["s"], r["alpha"]): r for r in timeseries.brown_smoothing(d, "t", "x", [0.3, 0.6], ahead=3, series=["s"]).collect()}
    monkeypatch.setattr(timeseries, "MEMORY", 250)
    parts = {(r["s"], r["alpha"]): r for r in timeseries.brown_smoothing(d, "t", "x", [0.3, 0.6], ahead=3, series=["s"], block=300).collect()}
    assert set(parts) == set(whole) == {(s, a) for s in ("a", None) for a in (0.3, 0.6)}
    for key, r in whole.items():
        assert tuple(parts[key])[2:] == pytest.approx(tuple(r)[2:], rel=1e-9)

    def plain(x, alpha, k, ahead):
        t = np.arange(1, k + 1)
        slope = ((t - t.mean()) * x[:k]).sum() / ((t - t.mean()) ** 2).sum()
        base, q = x[:k].mean() - slope * t.mean(), (1 - alpha) / alpha
        one, two, sse = base - q * slope, base - 2 * q * slope, 0.0
        for i in range(1, len(x)):
            one = alpha * x[i] + (1 - alpha) * one
            two = alpha * one + (1 - alpha) * two
            if i + 1 >= k and i + ahead < len(x):
                sse += (x[i + ahead] - (2 * one - two + alpha / (1 - alpha) * (one - two) * ahead)) ** 2
        return sse

    assert parts["a", 0.3]["sse"] == pytest.approx(plain(values, 0.3, 5, 3), rel=1e-9)
    assert timeseries.brown_smoothing(d.limit(0), "t", "x", [0.3]).count() == 0


def test_goodness_of_fit_edges(spark):
    def fit(values, family="gaussian"):
        return statistics.goodness_of_fit(spark.createDataFrame([(v,) for v in values], "x double"), "x", family)

    assert fit([None]) == {"chi2": None, "df": None, "p": None}
    assert fit([4.0, 4.0, None]) == {"chi2": 0.0, "df": 0, "p": 1.0}
    assert fit([0.0, 0.0], "poisson")["p"] == 1.0
    assert fit([-1.0, 2.0, 3.0], "poisson")["chi2"] == math.inf
    assert fit([-1.0, -2.0], "exponential") == {"chi2": math.inf, "df": 1, "p": 0.0}
    with pytest.raises(ValueError):
        fit([1.0], "cauchy")
    x = np.random.default_rng(1).poisson(4, 500).astype(float)
    for family in ("gaussian", "poisson", "exponential", "geometric", "binomial", "negative_binomial"):
        values, o = np.unique(x, return_counts=True)
        m, v = x.mean(), x.var(ddof=1)
        lg = math.lgamma
        r, p = m * m / max(v - m, 1e-12), m / values.max()
        share = {
            "gaussian": lambda k: math.exp(-((k - m) ** 2) / (2 * v)), "poisson": lambda k: math.exp(k * math.log(m) - m - lg(k + 1)), "exponential": lambda k: math.exp(-k / m), "geometric": lambda k: (m / (1 + m)) ** k,
            "binomial": lambda k: math.comb(int(values.max()), int(k)) * p**k * (1 - p) ** (values.max() - k), "negative_binomial": lambda k: math.exp(lg(k + r) - lg(k + 1) - lg(r) + r * math.log(r / (r + m)) + k * math.log(m / (r + m))),
        }[family]
        e = np.array([share(k) for k in values])
        e = e / e.sum() * 500
        assert fit(x.tolist(), family)["chi2"] == pytest.approx(((o - e) ** 2 / e).sum(), rel=1e-6)


def test_fits_of_empty_and_constant_columns(spark):
    d = spark.createDataFrame([(3.0, 1.0, 2.0), (3.0, 2.0, 4.0), (3.0, 3.0, 6.0), (None, 1.0, None)], "c double, x double, y double")
    none = d.limit(0)
    assert statistics.best_distribution(none, "c") == []
    assert {f["family"] for f in statistics.best_distribution(d, "c")} == {"poisson", "exponential"}
    with pytest.raises(ValueError):
        statistics.least_squares(none, "y", ["x"])
    exact = statistics.least_squares(d, "y", ["x"])
    assert exact["coefficients"] == pytest.approx({"1": 0.0, "x": 2.0}, abs=1e-9) and exact["r2"] == pytest.approx(1)
    level = statistics.least_squares(d, "c", ["x"])
    assert level["r2"] is None and level["n"] == 3
    assert statistics.least_squares(d.limit(1), "y", ["x"])["standard_errors"] == {"1": None, "x": None}
    assert profiling.histogram(none, "x").count() == 0
    assert profiling.histogram(d, "c").collect()[0]["count"] == 3
