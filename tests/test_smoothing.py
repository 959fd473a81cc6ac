"""Local regressions and decompositions equal plain versions that fit each place by itself."""

import math

import numpy as np
import pytest

from loomwork.operators import smoothing


def weighted_fit(x, y, w, at, degree):
    degree = min(degree, max(len(set(x[w > 0])) - 1, 0))  # one place alone gives a value, no slope
    powers = np.vander(x - at, degree + 1, increasing=True)
    root = np.sqrt(w)
    return np.linalg.lstsq(powers * root[:, None], y * root, rcond=None)[0][0]


def plain_curve(x, y, points, span, degree):
    q = min(len(x), max(degree + 1, math.floor(span * len(x) + 1e-9)))
    out = []
    for at in np.linspace(x.min(), x.max(), points):
        away = np.abs(x - at)
        h = np.sort(away)[q - 1]
        w = np.where(away <= h, (1 - (away / h) ** 3) ** 3, 0.0)
        out.append((at, h, int((away <= h).sum()), weighted_fit(x, y, w, at, degree)))
    return out


@pytest.mark.parametrize(("span", "degree"), [(0.3, 2), (0.75, 1), (1.0, 0)])
def test_curve_equals_plain_fits(spark, span, degree):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=150), np.repeat(0.25, 30)])
    y = np.sin(2 * x) + r.normal(size=180) / 5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, None), (float("nan"), 1.0)], "x double, y double")
    got = smoothing.local_curve(df, "x", "y", 15, span, degree).orderBy("point").collect()
    assert [(g["x"], g["width"], g["n"], g["fit"]) for g in got] == [pytest.approx(p, abs=1e-8) for p in plain_curve(x, y, 15, span, degree)]
    assert all(g["low"] < g["fit"] < g["high"] for g in got)


def test_curves_by_group(spark):
    r = np.random.default_rng(5)
    rows = [(g, float(v), float(v * v + e)) for g in ("a", None) for v, e in zip(r.normal(size=60), r.normal(size=60), strict=True)]
    df = spark.createDataFrame([*rows, ("one", 2.0, 3.0), ("one", 2.0, 5.0)], "g string, x double, y double")
    got = smoothing.local_curve(df, "x", "y", 9, 0.5, by=["g"]).collect()
    for g in ("a", None):
        own = np.array([(v, w) for h, v, w in rows if h == g])
        fits = [r["fit"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["point"])]
        assert fits == pytest.approx([p[3] for p in plain_curve(own[:, 0], own[:, 1], 9, 0.5, 2)], abs=1e-8)
    assert {(r["fit"], r["n"]) for r in got if r["g"] == "one"} == {(4.0, 2)}
    assert smoothing.local_curve(df.limit(0), "x", "y").count() == 0
    with pytest.raises(ValueError):
        smoothing.local_curve(df, "x", "y", span=1.5)


def plain_smooth(v, rho, q, degree, places):
    out, x = [], np.arange(len(v), dtype=float)
    for at in places:
        away = np.abs(x - at)
        nearest = np.sort(away)[min(q, len(v)) - 1] * max(1.0, q / len(v))
        w = np.where(away < nearest, (1 - np.minimum(away / nearest, 1) ** 3) ** 3, 0.0) * rho
        out.append(weighted_fit(x, v, w, at, degree))
    return np.array(out)


def plain_decomposition(y, period, window, trend_q, low_q, inner, outer):
    n = len(y)
    trend, season, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for round_ in range(outer + 1):
        for _ in range(inner):
            free = y - trend
            if window is None:
                means = np.array([np.average(free[p::period], weights=rho[p::period]) for p in range(period)])
                season = (means - means.mean())[np.arange(n) % period]
            else:
                cycle = np.zeros(n + 2 * period)
                for p in range(period):
                    part = free[p::period]
                    cycle[p::period] = plain_smooth(part, rho[p::period], window, 1, range(-1, len(part) + 1))
                slow = [np.mean(cycle[i : i + period]) for i in range(n + period + 1)]
                slow = [np.mean(slow[i : i + period]) for i in range(n + 2)]
                slow = np.array([np.mean(slow[i : i + 3]) for i in range(n)])
                season = cycle[period : n + period] - plain_smooth(slow, np.ones(n), low_q, 1, range(n))
            trend = plain_smooth(y - season, rho, trend_q, 1, range(n))
        if round_ < outer:
            rest = np.abs(y - season - trend)
            rho = (1 - np.minimum(rest / (6 * np.median(rest)), 1) ** 2) ** 2
    return season, trend, rho


def series(n, period, seed=1):
    r, t = np.random.default_rng(seed), np.arange(n)
    y = 10 + t / 40 + 3 * np.sin(2 * np.pi * t / period) * (1 + t / n) + r.normal(size=n) / 2
    y[n // 3] += 25
    return y


@pytest.mark.parametrize(("window", "outer", "block"), [(None, 0, 8192), (7, 0, 8192), (7, 2, 1), (None, 1, 40)])
def test_decomposition_equals_plain_one(spark, window, outer, block):
    """Blocks as small as a pass's reach change nothing."""
    y = series(300, 4)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(400, None), (None, 1.0)], "t int, v double")
    got = smoothing.decompose(df, "t", "v", 4, window, inner=2, outer=outer, block=block).orderBy("t").collect()
    trend_q = 7 if window is None else 9
    season, trend, rho = plain_decomposition(y, 4, window, trend_q, 5, 2, outer)
    assert len(got) == 300
    assert [r["seasonal"] for r in got] == pytest.approx(list(season), abs=1e-8)
    assert [r["trend"] for r in got] == pytest.approx(list(trend), abs=1e-8)
    assert [r["weight"] for r in got] == pytest.approx(list(rho), abs=1e-8)
    assert all(r["v"] == pytest.approx(r["seasonal"] + r["trend"] + r["remainder"]) for r in got)


def test_decompositions_of_several_series(spark):
    a, b = series(60, 6, 2), series(80, 6, 3)
    rows = [("a", i, float(v)) for i, v in enumerate(a)] + [(None, i, float(v)) for i, v in enumerate(b)] + [("short", i, 1.0) for i in range(11)]
    got = smoothing.decompose(spark.createDataFrame(rows, "s string, t int, v double"), "t", "v", 6, outer=1, series=["s"]).collect()
    for name, y in (("a", a), (None, b)):
        season, trend, _ = plain_decomposition(y, 6, None, 9, 7, 2, 1)
        own = sorted((r for r in got if r["s"] == name), key=lambda r: r["t"])
        assert [r["seasonal"] for r in own] == pytest.approx(list(season), abs=1e-8)
        assert [r["trend"] for r in own] == pytest.approx(list(trend), abs=1e-8)
    assert [(r["seasonal"], r["trend"]) for r in got if r["s"] == "short"] == [(None, None)] * 11


def test_seasonality(spark):
    r = np.random.default_rng(7)
    cycle = spark.createDataFrame([(i, float(math.exp(3 + i / 100 + math.sin(i * math.pi / 6) + r.normal() / 10))) for i in range(144)], "t int, v double")
    seasonal, parts = smoothing.detect_seasonality(cycle, "t", "v", 12)
    assert seasonal
    assert abs(smoothing.power_parameter(cycle, "t", "v", 12)) < 0.3  # spread grows with the level: near the logarithm
    assert smoothing.strengths(parts).first()["seasonal_strength"] > 0.9
    noise = spark.createDataFrame([(i, float(r.normal())) for i in range(144)], "t int, v double")
    assert smoothing.power_parameter(noise, "t", "v", 12) is None
    assert not smoothing.detect_seasonality(noise, "t", "v", 12)[0]
    assert smoothing.decompose(noise.limit(0), "t", "v", 12).count() == 0
    with pytest.raises(ValueError):
        smoothing.decompose(noise, "t", "v", 12, 4)
