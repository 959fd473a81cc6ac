"""Distribution functions in plain Python, for the few numbers that a report needs on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series for small x, continued fraction beyond."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def beta_i(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def chi2_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_i(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


def inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """The quantile by bisection; the bracket is widened until it holds it."""
    while cdf(high) < p:
        high = high * 2 + 1
    while cdf(low) > p:
        low = low * 2 - 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return inverse(lambda t: t_cdf(t, df), p, -10, 10)


def chi2_quantile(p: float, df: float) -> float:
    return inverse(lambda x: chi2_cdf(x, df), p, 0, df + 10)


def normal_quantile(p: float) -> float:
    return inverse(normal_cdf, p, -10, 10)
