"""Linear mixed models by maximum likelihood: random intercepts and slopes of one factor, and two crossed factors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored
from loomwork.functions.special import chi2_cdf

#: Fixed terms of a model, and levels of the second of two crossed factors, at most: a task holds their products.
MOST_TERMS, MOST_LEVELS = 60, 200
#: Steps beyond a round's own that are tried in the next pass over the groups.
STRIDES = (0.0, 1.0, 3.0, 8.0, 20.0, 60.0, 200.0)


@dataclass
class MixedFit:
    """Fixed effects with their covariance, variances of the random effects, and the log-likelihood after each round.

    The fixed effects are the best for the variances given; the last log-likelihood is at most a tolerance below theirs.
    """

    terms: list[str]
    effects: np.ndarray
    covariance: np.ndarray
    random: np.ndarray
    residual: float
    n: int
    groups: int
    rounds: list[float] = field(default_factory=list)
    random_terms: list[str] = field(default_factory=list)
    second: float | None = None

    @property
    def log_likelihood(self) -> float:
        return self.rounds[-1]

    @property
    def parameters(self) -> int:
        q = len(self.random)
        return len(self.effects) + q * (q + 1) // 2 + 1 + (self.second is not None)

    def table(self) -> list[tuple[str, float, float, float]]:
        """(term, estimate, standard error, t) of the fixed effects."""
        se = np.sqrt(np.diag(self.covariance))
        return [(t, float(b), float(s), float(b / s)) for t, b, s in zip(self.terms, self.effects, se, strict=True)]


def _design(df: DataFrame, y: str, fixed: Sequence[str] | Mapping[str, Column], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Complete rows as ``y``, ``x0`` (ones), ``x1``...; the names of the terms."""
    columns = dict(fixed) if isinstance(fixed, Mapping) else {c: F.col(c) for c in fixed}
    if len(columns) >= MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS - 1} fixed terms")
    require_columns(df, [y, *keep, *([] if isinstance(fixed, Mapping) else fixed)])
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *[c.cast("double").alias(f"x{i + 1}") for i, c in enumerate(columns.values())])
    good = F.lit(True)
    for c, t in rows.dtypes:
        good = good & F.col(c).isNotNull() & (~F.isnan(c) if t == "double" else F.lit(True))
    return rows.where(good), ["(intercept)", *columns]


def group_products(rows: DataFrame, terms: int) -> DataFrame:
    """(k0, n, yy, xy, xx): a row per group with the sums of products of its rows; all that a model of one factor needs to know of them."""
    x = [f"x{i}" for i in range(terms)]
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(x) for b in x[i:]]
    g = rows.groupBy("k0").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.array(*[F.sum(F.col("y") * F.col(c)) for c in x]).alias("xy"), F.array(*sums).alias("xx"))
    return g


def _unpack(flat: np.ndarray, p: int) -> np.ndarray:
    """Upper triangles, a row each, as symmetric matrices."""
    out = np.empty((len(flat), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = out[:, j, i] = flat
    return out


def _posterior(a: np.ndarray, b: np.ndarray, z: list[int], point: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, ...]:
    """Per group: Z'Z, Z'X, Z'(y - X beta), covariance and mean of its random effects, and I + psi Z'Z / s2."""
    beta, psi, s2 = point
    zz, zx = a[:, z][:, :, z], a[:, z]
    u = b[:, z] - zx @ beta
    inner = np.eye(len(z)) + psi @ zz / s2
    c = np.linalg.solve(inner, np.broadcast_to(psi, inner.shape))
    return zz, zx, u, c, np.einsum("gij,gj->gi", c, u) / s2, inner


def _expectations(batches: Iterator[pd.DataFrame], p: int, z: list[int], points: list[tuple[np.ndarray, np.ndarray, float]]) -> Iterator[pd.DataFrame]:
    """For each point the sums over this task's groups: log-likelihood, E bb', and the normal equations of y on X and of y on Z b."""
    q, total = len(z), None
    for d in batches:
        if not len(d):
            continue
        n, yy, b = d["n"].to_numpy(), d["yy"].to_numpy(), np.stack(d["xy"].to_list())
        a = _unpack(np.stack(d["xx"].to_list()), p)
        here = []
        for beta, psi, s2 in points:
            zz, zx, u, c, m, inner = _posterior(a, b, z, (beta, psi, s2))
            rr = yy - 2 * b @ beta + np.einsum("i,gij,j->g", beta, a, beta)
            ll = -0.5 * (n * math.log(2 * math.pi * s2) + np.linalg.slogdet(inner)[1] + rr / s2 - np.einsum("gi,gi->g", u, m) / s2)
            bb = m[:, :, None] * m[:, None, :] + c
            xva = np.einsum("gip,gij,gjr->pr", zx, c, zx) / s2**2
            xvy = np.einsum("gip,gij,gj->p", zx, c, b[:, z]) / s2**2
            here.append(np.concatenate([[ll.sum()], bb.sum(0).ravel(), np.einsum("gip,gj->pij", zx, m).ravel(), np.einsum("gik,gjl->ijkl", zz, bb).ravel(), np.einsum("gi,gj->ij", b[:, z], m).ravel(), xva.ravel(), xvy]))
        now = np.stack(here)
        total = now if total is None else total + now
    if total is not None:
        yield pd.DataFrame({"i": range(len(points)), "s": list(total)})


def _coordinates(psi: np.ndarray, s2: float) -> np.ndarray:
    """Variances without bounds: the triangular root, its diagonal as logarithms, and the log of s2."""
    size = np.sqrt(np.maximum(np.diag(psi), 1e-300))
    root = size[:, None] * np.linalg.cholesky(psi / np.outer(size, size) + 1e-13 * np.eye(len(psi)))
    out = np.tril(root, -1) + np.diag(np.log(np.diag(root)))
    return np.append(out.ravel(), math.log(s2))


def _further(old: tuple[np.ndarray, np.ndarray, float], new: tuple[np.ndarray, np.ndarray, float], stride: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The point ``stride`` steps beyond the step from ``old`` to ``new``."""
    if not stride:
        return new
    a, b, q = _coordinates(old[1], old[2]), _coordinates(new[1], new[2]), len(new[1])
    c = b + stride * (b - a)
    on = np.append(np.eye(q, dtype=bool).ravel(), True)
    c[on] = np.clip(c[on], np.maximum(b[on] - 8, -200), np.minimum(b[on] + 8, 200))
    root = c[:-1].reshape(q, q)
    root = np.tril(root, -1) + np.diag(np.exp(np.diag(root)))
    return new[0] + stride * (new[0] - old[0]), root @ root.T, float(np.exp(c[-1]))


def mixed_model(df: DataFrame, y: str, fixed: Sequence[str] | Mapping[str, Column], group: str, slopes: Sequence[str] = (), tolerance: float = 1e-5, most_rounds: int = 200) -> MixedFit:
    """``y`` on the ``fixed`` terms and an intercept, with a random intercept and random ``slopes`` (some of the fixed terms) per ``group``, by maximum likelihood.

    One aggregate gives each group's products; rounds run over those, a row per group, however many rows or how large a hot group is. A round is
    expectation-maximisation with an expanded parameter (the loadings of the random effects are fitted along with the fixed ones), and each
    pass also tries points further along the last step and goes on from the best: the log-likelihood never falls. Rounds end when it
    rises by less than ``tolerance``. Rows with a null or NaN in a column that is used are left out. Raises ValueError for fewer complete rows than terms, for terms that
    depend on each other, where nothing is left as a residual, and when ``most_rounds`` don't settle.
    """
    rows, terms = _design(df, y, fixed, [group])
    p, z = len(terms), [0, *[terms.index(s) for s in slopes]]
    q = len(z)
    table = stored(group_products(rows, p).coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    s = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("yy").alias("yy"), *[F.sum(F.col("xy")[i]).alias(f"b{i}") for i in range(p)], *[F.sum(F.col("xx")[i]).alias(f"a{i}") for i in range(p * (p + 1) // 2)]).first()
    n, groups = int(s["n"] or 0), s["groups"]
    if n <= p:
        raise ValueError(f"{n} complete rows are too few for {p} terms")
    xx, xy, yy = _unpack(np.array([[s[f"a{i}"] for i in range(p * (p + 1) // 2)]]), p)[0], np.array([s[f"b{i}"] for i in range(p)]), s["yy"]
    size = np.sqrt(np.diag(xx))
    if not size.all() or np.linalg.eigvalsh(xx / np.outer(size, size))[0] < 1e-11:
        raise ValueError("the fixed terms depend on each other")
    beta = np.linalg.solve(xx, xy)
    s2 = float(yy - beta @ xy) / n
    if not s2 > 1e-12 * max(yy / n, 1e-300):
        raise ValueError("the fixed terms leave no residual")
    point = (beta, np.diag([s2 / 2 / (xx[i, i] / n) for i in z]), s2 / 2)
    points, fit = [point], MixedFit(terms, beta, xx, point[1], s2, n, groups, random_terms=[terms[i] for i in z])
    cuts = np.cumsum([1, q * q, p * q * q, q**4, q * q, p * p])
    for _ in range(most_rounds):
        tried = points
        got = table.mapInPandas(lambda it, t=tried: _expectations(it, p, z, t), "i int, s array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(int(cuts[-1]) + p)]).alias("s")).collect()  # a row per point
        sums = {r["i"]: np.array(r["s"]) for r in got}
        best = max((i for i in sums if np.isfinite(sums[i]).all()), key=lambda i: sums[i][0])
        point, (ll, bb, xa, aa, ay, drop, drop_y) = tried[best], np.split(sums[best], cuts)
        rise = float(ll[0]) - fit.rounds[-1] if fit.rounds else math.inf
        _, fit.random, fit.residual = point
        fit.rounds.append(float(ll[0]))
        fit.covariance = np.linalg.inv(xx / point[2] - drop.reshape(p, p))
        fit.effects = fit.covariance @ (xy / point[2] - drop_y)  # the best for these variances
        if rise < tolerance:
            return fit
        both = np.block([[xx, xa.reshape(p, q * q)], [xa.reshape(p, q * q).T, aa.reshape(q * q, q * q)]])
        right = np.concatenate([xy, ay])
        scale = np.sqrt(np.maximum(np.diag(both), 1e-300))
        both_scaled = both / np.outer(scale, scale)
        theta = np.linalg.lstsq(both_scaled, right / scale, rcond=1e-13)[0] / scale
        loading = theta[p:].reshape(q, q)
        psi = loading @ (bb.reshape(q, q) / groups) @ loading.T
        new = (theta[:p], (psi + psi.T) / 2, float(yy - 2 * theta @ right + theta @ both @ theta) / n)
        if not new[2] > 1e-12 * max(yy / n, 1e-300):
            raise ValueError("the groups leave no residual")
        points = [_further(point, new, stride) for stride in STRIDES]
    raise ValueError("the rounds don't settle")


def random_effects(df: DataFrame, fit: MixedFit, y: str, fixed: Sequence[str] | Mapping[str, Column], group: str) -> DataFrame:
    """(group, n, effects): the expected random effects of each group given its rows, in the order of ``fit.random_terms``."""
    rows, terms = _design(df, y, fixed, [group])
    p, z, point = len(terms), [terms.index(t) for t in fit.random_terms], (fit.effects, fit.random, fit.residual)
    products = group_products(rows, p)

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                m = _posterior(_unpack(np.stack(d["xx"].to_list()), p), np.stack(d["xy"].to_list()), z, point)[4]
                yield pd.DataFrame({"k0": d["k0"], "n": d["n"].astype("int64"), "effects": list(m)})

    kind = products.schema["k0"].dataType.simpleString()
    return products.mapInPandas(effects, f"k0 {kind}, n long, effects array<double>").withColumnRenamed("k0", group)


def likelihood_ratio(smaller: MixedFit, larger: MixedFit) -> tuple[float, int, float]:
    """(chi-squared, degrees of freedom, p) of two nested models of the same rows."""
    if smaller.n != larger.n:
        raise ValueError("the models were fitted on different rows")
    x, df = 2 * (larger.log_likelihood - smaller.log_likelihood), larger.parameters - smaller.parameters
    if df < 1:
        raise ValueError("the second model must have more parameters")
    return max(0.0, x), df, 1 - chi2_cdf(max(0.0, x), df)


def criteria(fit: MixedFit) -> tuple[float, float]:
    """(AIC, BIC)."""
    return 2 * fit.parameters - 2 * fit.log_likelihood, math.log(fit.n) * fit.parameters - 2 * fit.log_likelihood


def _profile(m: np.ndarray, logs: float, p: int, n: int) -> tuple[float, float, np.ndarray, np.ndarray, float]:
    """The best second variance given the first: (log-likelihood, ratio, effects, covariance over s2, s2). ``m`` has the products of X, levels and y after the first factor."""
    h = m.shape[0] - p - 1
    x, v = slice(0, p), slice(p, p + h)
    mxx, mxv, mvv, rx, rv, yy = m[x, x], m[x, v], m[v, v], m[x, -1], m[v, -1], m[-1, -1]

    def at(kappa: float) -> tuple[float, float, np.ndarray, np.ndarray, float]:
        c = kappa * np.linalg.inv(np.eye(h) + kappa * mvv)
        a = mxx - mxv @ c @ mxv.T
        beta = np.linalg.solve(a, rx - mxv @ c @ rv)
        off = rv - mxv.T @ beta
        s2 = max(float(yy - 2 * beta @ rx + beta @ mxx @ beta - off @ c @ off) / n, 1e-300)
        ll = -0.5 * (n * (math.log(2 * math.pi * s2) + 1) + logs + np.linalg.slogdet(np.eye(h) + kappa * mvv)[1])
        return float(ll), kappa, beta, np.linalg.inv(a), s2

    low, high, best = -20.0, 12.0, at(0.0)
    for _ in range(14):
        step = (high - low) / 10
        found = max((at(math.exp(low + i * step)) for i in range(11)), key=lambda t: t[0])
        low, high = math.log(found[1]) - step, math.log(found[1]) + step
        best = max(best, found, key=lambda t: t[0])
    return best


def crossed_model(df: DataFrame, y: str, fixed: Sequence[str] | Mapping[str, Column], group: str, second: str, passes: int = 9) -> MixedFit:
    """``y`` on the ``fixed`` terms with random intercepts of ``group`` (any number) and of ``second`` (at most 200 levels, else ValueError), crossed in any way, by maximum likelihood.

    A group's rows count through their sums of terms and levels, a row per group. Each pass over those tries ratios of the first variance to the residual one on a
    grid that closes in; for each the other variance and the fixed effects are solved from the products it leaves. Both factors enter the likelihood exactly. Rows with nulls are left out.
    """
    rows, terms = _design(df, y, fixed, [group, second])
    levels = [r[0] for r in rows.select("k1").distinct().limit(MOST_LEVELS + 1).collect()]
    if not levels:
        raise ValueError("no complete rows")
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"the second factor has more than {MOST_LEVELS} levels; make it the group")
    levels.sort()
    p, h = len(terms), len(levels)
    columns = [f"x{i}" for i in range(p)] + [f"v{i}" for i in range(h)] + ["y"]
    wide = rows.select("k0", "y", *columns[:p], *[(F.col("k1") == F.lit(v)).cast("double").alias(f"v{i}") for i, v in enumerate(levels)])
    table = stored(wide.groupBy("k0").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(c) for c in columns]).alias("s")))
    w = len(columns)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((w, w)), 0
        for d in batches:
            x = d[columns].to_numpy()
            total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame({"n": [n], "s": [total.ravel()]})

    def add(part: DataFrame) -> list[tuple[int, float, np.ndarray]]:
        each = part.select("i", "n", F.posexplode("s").alias("j", "v")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("i", "j").toPandas()  # products per grid point
        return [(i, float(g["n"].iloc[0]), g["v"].to_numpy().reshape(w, w)) for i, g in each.groupby("i")]

    parts = wide.select(*columns).mapInPandas(gram, "n double, s array<double>").withColumn("i", F.lit(0))
    _, n, whole = add(parts)[0]
    groups = table.count()
    low, high, best, rounds = -12.0, 10.0, None, []
    for k in range(passes):
        step = (high - low) / 8
        grid = ([0.0] if k == 0 else []) + [math.exp(low + i * step) for i in range(9)]

        def left(batches: Iterator[pd.DataFrame], grid: list[float] = grid) -> Iterator[pd.DataFrame]:
            total, logs = np.zeros((len(grid), w, w)), np.zeros(len(grid))
            for d in batches:
                if len(d):
                    size, s = d["n"].to_numpy(), np.stack(d["s"].to_list())
                    for i, lam in enumerate(grid):
                        total[i] += (s * (lam / (1 + lam * size))[:, None]).T @ s
                        logs[i] += np.log1p(lam * size).sum()
            yield pd.DataFrame({"i": range(len(grid)), "n": logs, "s": [t.ravel() for t in total]})

        got = [(*_profile(whole - out, logs, p, int(n)), grid[i]) for i, logs, out in add(table.mapInPandas(left, "i int, n double, s array<double>"))]
        found = max(got, key=lambda t: t[0])
        best = found if best is None or found[0] > best[0] else best
        rounds.append(best[0])
        centre = max((g for g in got if g[-1] > 0), key=lambda t: t[0])[-1]
        low, high = math.log(centre) - step, math.log(centre) + step
    _, kappa, beta, cov, s2, lam = best
    return MixedFit(terms, beta, cov * s2, np.array([[lam * s2]]), s2, int(n), groups, rounds, ["(intercept)"], kappa * s2)
