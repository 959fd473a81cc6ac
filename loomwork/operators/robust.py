"""Outliers over several columns by a robust covariance and by a one-class support vector machine."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored
from loomwork.functions.ordered import quantile_values
from loomwork.functions.special import chi2_quantile

#: Rows from which concentration starts, at most.
SAMPLE = 1500
#: Random features that stand for the radial kernel, and bins of the scores in which a pass adds them up.
FEATURES, BINS = 256, 512
#: Rows from which on one more task scores them, as far as there are cores.
TASK_ROWS = 5_000


@dataclass
class RobustFit:
    """Centre and covariance of the columns, and the determinants (of the scaled columns) after each concentration step of the best start."""

    centre: np.ndarray
    covariance: np.ndarray
    determinants: list[float] = field(default_factory=list)


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(good)


def _distance2(columns: Sequence[Column], centre: np.ndarray, covariance: np.ndarray) -> Column:
    """Mahalanobis distance, squared, as a plain expression: the sum of squares of the rows of a triangular root."""
    root = np.linalg.inv(np.linalg.cholesky(covariance))
    off = [c - F.lit(float(m)) for c, m in zip(columns, centre, strict=True)]
    parts = [sum((off[j] * F.lit(float(root[i, j])) for j in range(i + 1)), F.lit(0.0)) for i in range(len(columns))]
    return sum((p * p for p in parts), F.lit(0.0))


def _sums(rows: DataFrame, names: Sequence[str], weights: Sequence[Column]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, sums, sums of products) for each weighting, in one aggregate."""
    p = len(names)
    sums = []
    for k, w in enumerate(weights):
        sums += [F.sum(w).alias(f"n{k}"), *[F.sum(w * F.col(c)).alias(f"m{k}_{i}") for i, c in enumerate(names)]]
        sums += [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"s{k}_{i}_{j}") for i in range(p) for j in range(i, p)]
    r = rows.agg(*sums).first()
    out = []
    for k in range(len(weights)):
        s = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                s[i, j] = s[j, i] = r[f"s{k}_{i}_{j}"]
        out.append((r[f"n{k}"], np.array([r[f"m{k}_{i}"] for i in range(p)]), s))
    return out


def _moments(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = sums / n
    return mean, products / n - np.outer(mean, mean)


def _sample_starts(x: np.ndarray, share: float, starts: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different (centre, covariance) of least determinant by concentration inside a bounded sample, from many random small subsets."""
    n, p = x.shape
    h, rng = max(p + 1, int(math.ceil(share * n))), np.random.default_rng(seed)

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        y = x - mean
        near = x[np.argsort(np.einsum("ij,jk,ik->i", y, np.linalg.pinv(cov), y), kind="stable")[:h]]
        cov = np.cov(near.T, bias=True).reshape(p, p)
        return near.mean(0), cov, float(np.linalg.det(cov))

    tried = []
    for _ in range(100):
        first = x[rng.choice(n, min(n, p + 1), replace=False)]
        fit = (first.mean(0), np.cov(first.T, bias=True).reshape(p, p) + 1e-9 * np.eye(p))
        for _ in range(2):
            *fit, det = step(*fit)
        tried.append((det, *fit))
    tried.sort(key=lambda t: t[0])
    best: list[tuple[float, np.ndarray, np.ndarray]] = []
    for _, mean, cov in tried[:10]:
        last = math.inf
        for _ in range(50):
            mean, cov, det = step(mean, cov)
            if not det < last:
                break
            last = det
        if all(abs(det - b[0]) > 1e-9 * max(det, b[0]) for b in best):
            best.append((det, mean, cov))
    return [(m, c) for _, m, c in sorted(best, key=lambda t: t[0])[:starts]]


def robust_covariance(df: DataFrame, columns: Sequence[str], share: float = 0.5, starts: int = 3, seed: int = 1, most_steps: int = 30) -> RobustFit:
    """Centre and covariance of the ``share`` of complete rows (and a few more, (n + p + 1) / 2 at one half) whose covariance has the least determinant, reweighted.

    Starts come from at most 1,500 rows, by hash. All rows then concentrate: distances to each start are expressions of the row, the
    exact order statistic of the distances says which rows are inside (rows at it count in part, so that the weight is the same each
    time), and one aggregate gives the new centres and covariances of all starts; no determinant ever rises. At the end the median distance makes
    the covariance consistent, and rows up to the 97.5 % point of chi-squared give the result. Raises ValueError where there are fewer than
    2 p complete rows, or where those inside lie in a plane.
    """
    require_columns(df, columns)
    names, p = [f"x{i}" for i in range(len(columns))], len(columns)
    raw = _known(df, columns).select(*[F.col(c).cast("double").alias(x) for c, x in zip(columns, names, strict=True)])
    s = raw.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{x}") for x in names], *[F.stddev_pop(x).alias(f"s{x}") for x in names]).first()
    n = s["n"]
    if n < 2 * p:
        raise ValueError(f"{n} complete rows are too few for {p} columns")
    mid, size = np.array([s[f"m{x}"] for x in names]), np.array([s[f"s{x}"] or 1.0 for x in names])
    rows = stored(raw.select(*[((F.col(x) - F.lit(float(m))) / F.lit(float(d))).alias(x) for x, m, d in zip(names, mid, size, strict=True)]))
    h = (n + p + 1) // 2 if share == 0.5 else max(p + 1, math.ceil(share * n))
    sample = np.array(rows.select(*names, F.xxhash64(*names, F.lit(seed)).alias("h")).orderBy("h", *names).limit(SAMPLE).drop("h").collect(), dtype=np.float64)
    fits = _sample_starts(sample, h / n, starts, seed)
    history: list[list[float]] = [[] for _ in fits]
    x = [F.col(c) for c in names]
    for _ in range(most_steps):
        if any(np.linalg.eigvalsh(c)[0] <= 1e-12 for _, c in fits):
            raise ValueError("over the share asked for of the rows lie in one plane")
        away = {f"d{k}": _distance2(x, *f) for k, f in enumerate(fits)}
        cut = {k: v[0] for k, v in quantile_values(rows, away, ((h - 1) / max(1, n - 1),)).items()}
        inside = [F.col(k) < F.lit(c * (1 - 1e-9)) for k, c in cut.items()]
        at = [~i & (F.col(k) <= F.lit(c * (1 + 1e-9))) for i, (k, c) in zip(inside, cut.items(), strict=True)]
        one = lambda c: F.when(c, 1.0).otherwise(0.0)
        found = _sums(rows.withColumns(away), names, [one(c) for pair in zip(inside, at, strict=True) for c in pair])
        fits = []
        for (n_in, m_in, s_in), (n_at, m_at, s_at) in zip(found[::2], found[1::2], strict=True):
            part = (h - n_in) / max(1.0, n_at)
            fits.append(_moments(n_in + part * n_at, m_in + part * m_at, s_in + part * s_at))
        for k, (_, c) in enumerate(fits):
            history[k].append(float(np.linalg.det(c)))
        if len(history[0]) > 1 and all(d[-1] >= d[-2] * (1 - 1e-10) for d in history):
            break
    best = min(range(len(fits)), key=lambda k: history[k][-1])
    centre, cov = fits[best]
    middle = quantile_values(rows, {"d": _distance2(x, centre, cov)}, (0.5,))["d"][0]
    cov = cov * (middle / chi2_quantile(0.5, p))
    near = F.when(_distance2(x, centre, cov) <= chi2_quantile(0.975, p), 1.0).otherwise(0.0)
    weight, *sums = _sums(rows, names, [near])[0]
    centre, cov = _moments(weight, *sums)
    cov = cov * weight / max(1.0, weight - 1)
    return RobustFit(mid + size * centre, cov * np.outer(size, size), history[best])


def elliptic_flags(df: DataFrame, columns: Sequence[str], contamination: float = 0.1, out: str = "outlier", seed: int = 1) -> DataFrame:
    """``df`` with ``distance2``, the squared distance under the robust covariance, and ``out``: 1 beyond the 1 - ``contamination`` point of chi-squared, else 0; null for incomplete rows.

    Where there is no robust covariance (see ``robust_covariance``) all is null.
    """
    try:
        fit = robust_covariance(df, columns, seed=seed)
    except ValueError:
        return df.withColumn("distance2", F.lit(None).cast("double")).withColumn(out, F.lit(None).cast("int"))
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    d = df.withColumn("distance2", _distance2(x, fit.centre, fit.covariance))
    return d.withColumn(out, (F.col("distance2") > chi2_quantile(1 - contamination, len(columns))).cast("int"))


@dataclass
class OneClass:
    """Random features (weights, phases), the weights over them, and the duality gap over their squared length after each pass."""

    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    gaps: list[float] = field(default_factory=list)

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)


def _matrix(b: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    return b[list(names)].to_numpy(np.float64)


def _bin_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (k, n, s, least, most) added up by k."""
    held: dict[int, list] = {}
    for b in batches:
        for k, n, s, least, most in zip(b["k"], b["n"], b["s"], b["least"], b["most"], strict=True):
            x = held.setdefault(k, [0.0, np.zeros(len(s)), math.inf, -math.inf])
            held[k] = [x[0] + n, x[1] + s, min(x[2], least), max(x[3], most)]
    yield pd.DataFrame([(k, *v) for k, v in held.items()], columns=["k", "n", "s", "least", "most"])


def _least_norm(corners: list[np.ndarray], shares: np.ndarray, corner: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The corners and their shares in the shortest average of ``corners`` (whose own is ``shares``) and one more; no more are kept than needed (Wolfe's corral)."""
    corners, shares = [*corners, corner], np.append(shares, 0.0)
    while True:
        a = np.array(corners)
        g = a @ a.T
        m = np.ones((len(a) + 1, len(a) + 1))
        m[0, 0], m[1:, 1:] = 0.0, g / (np.trace(g) / len(a) or 1.0)
        to = np.linalg.lstsq(m, np.append(1.0, np.zeros(len(a))), rcond=None)[0][1:]
        if (to > -1e-12).all():
            to = np.maximum(to, 0.0)
            return corners, to / to.sum()
        down = to <= -1e-12
        t = (shares[down] / (shares[down] - to[down])).min()  # as far as all shares stay positive; who reaches none goes
        shares = shares + t * (to - shares)
        keep = shares > 1e-12
        keep[down] &= shares[down] > shares[down].min()
        corners, shares = [c for c, k in zip(corners, keep, strict=True) if k], shares[keep] / shares[keep].sum()


def fit_one_class(rows: DataFrame, names: Sequence[str], nu: float, gamma: float, features: int = FEATURES, passes: int = 60, tolerance: float = 1e-3, seed: int = 1) -> OneClass:
    """The one-class machine over scaled ``rows``, by conditional gradients on its dual: least |w| over averages w of features with no row's weight above 1 / (nu n).

    Each pass scores all rows where they are and adds up features by bins of the score; the average of the lowest ``nu`` of them (the last
    bin in part) is the corner of the dual to go to, and w becomes the shortest average of the corners found so far, which needs about half the
    passes of going straight to each. What a pass sends is a row a task and bin to no more tasks than it has itself, and the gap to the optimum is known after each.
    """
    rng = np.random.default_rng(seed)
    model = OneClass(rng.normal(0, math.sqrt(2 * gamma), (len(names), features)), rng.uniform(0, 2 * math.pi, features), np.zeros(features))
    low, high, corners, shares = 0.0, 1.0, [], np.ones(1)
    rows = rows.select(*names)
    merging = min(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(passes + 1):
        width = (high - low) / BINS or 1.0

        def add(batches: Iterator[pd.DataFrame], model: OneClass = model, low: float = low, width: float = width) -> Iterator[pd.DataFrame]:
            n, sums, least, most = np.zeros(BINS), np.zeros((BINS, features)), math.inf, -math.inf
            for b in batches:
                phi = model.features(_matrix(b, names))
                score = phi @ model.weights
                k = np.clip((score - low) / width, 0, BINS - 1).astype(int)
                order, count = np.argsort(k, kind="stable"), np.bincount(k, minlength=BINS)
                at = np.flatnonzero(count)
                n += count
                if len(at):
                    sums[at] += np.add.reduceat(phi[order], (np.cumsum(count) - count)[at])
                least, most = min(least, score.min(initial=math.inf)), max(most, score.max(initial=-math.inf))
            at = np.flatnonzero(n)
            yield pd.DataFrame({"k": at, "n": n[at], "s": list(sums[at]), "least": least, "most": most})

        got = rows.mapInPandas(add, "k int, n double, s array<double>, least double, most double")
        if merging > 1:
            got = got.repartition(merging, "k").mapInPandas(_bin_sums, "k int, n double, s array<double>, least double, most double")
        sums = got.toPandas().sort_values("k")  # a row per bin
        if not len(sums):
            return model
        n, phi = sums["n"].to_numpy(), np.stack(sums["s"].to_list())
        total = n.sum()
        if not corners:  # all scores are equal: the average of all rows is a corner of the dual as good as any
            model.weights = phi.sum(0) / total
            corners = [model.weights]
            size = float(np.linalg.norm(model.weights)) or 1.0
            low, high = -2 * size, 2 * size
            continue
        room = nu * total
        share = np.clip((room - (np.cumsum(n) - n)) / n, 0, 1)
        corner = (phi * share[:, None]).sum(0) / room
        w = model.weights
        model.gaps.append(float(w @ (w - corner)) / max(float(w @ w), 1e-300))
        if model.gaps[-1] <= tolerance:
            break
        corners, shares = _least_norm(corners, shares, corner)
        model = OneClass(model.directions, model.phases, shares @ np.array(corners), model.gaps)
        low, high = sums["least"].min(), sums["most"].max()
    return model


def one_class_flags(df: DataFrame, columns: Sequence[str], nu: float = 0.05, gamma: float | None = None, out: str = "outlier", features: int = FEATURES, seed: int = 1) -> DataFrame:
    """``df`` with ``one_class_score`` and ``out``: 1 for the rows whose score lies below its exact ``nu`` quantile, else 0; null for incomplete rows.

    Columns are scaled to mean 0 and deviation 1; the kernel is exp(-gamma d^2), gamma 1 / (number of columns) unless given, by random
    features. Columns that don't vary say nothing. No complete rows: all null.
    """
    require_columns(df, columns)
    names = [f"__x{i}" for i in range(len(columns))]
    s = _known(df, columns).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    if not s["n"]:
        return df.withColumn("one_class_score", F.lit(None).cast("double")).withColumn(out, F.lit(None).cast("int"))
    d = df
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        d = d.withColumn(names[i], F.when(~F.isnan(x), (x - F.lit(float(s[f"m{i}"]))) / F.lit(float(s[f"s{i}"] or 1.0))))
    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-s["n"] // TASK_ROWS)))
    model = fit_one_class(stored(d.dropna(subset=names).select(*names).repartition(tasks)), names, nu, gamma or 1 / len(columns), features, seed=seed)

    @F.pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        m = np.column_stack([v.to_numpy(np.float64, na_value=np.nan) for v in x])
        return pd.Series(model.features(m) @ model.weights)

    complete = F.lit(True)
    for x in names:
        complete = complete & F.col(x).isNotNull()
    scored = stored(d.withColumn("one_class_score", F.when(complete, score(*names))).drop(*names))
    cut = quantile_values(scored, ["one_class_score"], (nu,))["one_class_score"][0]
    return scored.withColumn(out, (F.col("one_class_score") < F.lit(cut)).cast("int"))
