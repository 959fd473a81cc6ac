"""Tests, effect sizes, fits and regressions, each from a few aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.core import stored
from loomwork.functions.ordered import in_blocks, numbered, quantile_values, ranks_of_counts
from loomwork.functions.special import chi2_cdf, f_cdf, t_cdf, t_quantile


def _log_shares(family: str, m: float, v: float, most: float) -> Callable[[np.ndarray], np.ndarray]:
    """The logarithm of a family's density by moments (mean, variance, greatest value), but for a constant; minus infinity where it has none."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    if family not in ("gaussian", "poisson", "exponential", "geometric", "binomial", "negative_binomial"):
        raise ValueError(f"no such family: {family}")

    def f(x: np.ndarray) -> np.ndarray:
        if family == "gaussian":
            return -((x - m) ** 2) / (2 * v) if v > 0 else np.zeros(len(x))
        if m <= 0:  # all of it at 0
            return np.where(x == 0, 0.0, -np.inf)
        ok = x >= 0
        y = np.where(ok, x, 0.0)
        if family == "poisson":
            e = y * math.log(m) - lg(y + 1)
        elif family == "exponential":
            e = -y / m
        elif family == "geometric":
            e = y * math.log(1 - 1 / (1 + m))
        elif family == "binomial":
            size = max(most, 1.0)
            p = min(max(m / size, 1e-12), 1 - 1e-12)
            e = -lg(y + 1) - lg(size - y + 1) + y * math.log(p) + (size - y) * math.log1p(-p)
        else:
            r = m * m / max(v - m, 1e-12)
            e = lg(y + r) - lg(y + 1) + y * math.log(m / (r + m))
        return np.where(ok, e, -np.inf)

    return f


def goodness_of_fit(df: DataFrame, column: str, family: str = "gaussian") -> dict[str, float | None]:
    """Chi-square of category counts against the family's density there, parameters by moments, expected shares scaled to 1.

    Categories are counted, weighed and added up by the tasks, any number of them. A category that the family gives no share makes chi2
    infinite and p 0; a single category fits (p is 1); a column without values has no figures (None).
    """
    _log_shares(family, 1.0, 1.0, 1.0)
    x = F.col(column).cast("double")
    counts = stored(df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("o")))
    s = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("o").alias("n"), F.sum(F.col("x") * F.col("o")).alias("s"), F.max("x").alias("most")).first()
    k, n = s["k"], s["n"]
    if not k:
        return {"chi2": None, "df": None, "p": None}
    m = s["s"] / n
    v = counts.agg(F.sum((F.col("x") - F.lit(m)) * (F.col("x") - F.lit(m)) * F.col("o"))).first()[0] / max(n - 1, 1)
    f = _log_shares(family, m, v, s["most"])
    log_share = F.pandas_udf(lambda x: pd.Series(f(x.to_numpy(dtype=float))), "double")
    weighed = stored(counts.select("o", log_share("x").alias("e")))
    top = weighed.agg(F.max("e")).first()[0]
    if top == -math.inf:
        return {"chi2": math.inf, "df": k - 1, "p": 0.0}
    shares = weighed.select("o", F.exp(F.col("e") - F.lit(top)).alias("e"))
    scale = n / shares.agg(F.sum("e")).first()[0]
    e = F.col("e") * F.lit(scale)
    chi2 = shares.agg(F.sum(F.when(e > 0, (F.col("o") - e) * (F.col("o") - e) / e).otherwise(math.inf))).first()[0]
    return {"chi2": chi2, "df": k - 1, "p": 1.0 if k == 1 else 0.0 if chi2 == math.inf else 1 - chi2_cdf(chi2, k - 1)}


def _per_value(f: Callable[[float], float]) -> Callable[..., Column]:
    """A plain function as a column function, for distinct values."""

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(f).astype("float64")

    return apply


def best_distribution(df: DataFrame, column: str, criterion: str = "aic") -> list[dict[str, float | str]]:
    """Families by AIC (or BIC), best first, fitted by maximum likelihood from one aggregate.

    Negative values leave only the gaussian; poisson needs integers, gamma and log-normal positive values; where all values are
    equal, those with a variance (whose likelihood has no bound) are left out. A column without values has no fits.
    """
    x = F.col(column).cast("double")
    s = df.where(x.isNotNull()).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.min(x).alias("lo"), F.sum(x).alias("s"), F.min((x == F.floor(x)).cast("int")).alias("whole"),
        F.avg(F.when(x > 0, F.log(x))).alias("ml"), F.var_pop(F.when(x > 0, F.log(x))).alias("vl"),
    ).first()
    n, m = s["n"], s["m"]
    if not n:
        return []
    fits = [("gaussian", 2, -n / 2 * (math.log(2 * math.pi * s["v"]) + 1))] if s["v"] > 0 else []
    if s["lo"] >= 0 and m > 0:
        if s["whole"]:
            counts = df.where(x.isNotNull()).groupBy(x.alias("x")).count()
            factorials = counts.agg(F.sum(F.col("count") * _per_value(lambda v: math.lgamma(v + 1))("x"))).first()[0]
            fits.append(("poisson", 1, s["s"] * math.log(m) - n * m - factorials))
        fits.append(("exponential", 1, -n * math.log(m) - n))
    if s["lo"] > 0:
        if s["vl"] > 0:
            fits.append(("log_normal", 2, -n / 2 * (math.log(2 * math.pi * s["vl"]) + 1) - n * s["ml"]))
        gap = math.log(m) - s["ml"]
        if gap > 0 and s["v"] > 0:
            a = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
            for _ in range(50):  # Newton on log a - digamma(a) = gap, derivatives by differences of lgamma
                h = 1e-5 * a
                digamma = (math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h)
                trigamma = (math.lgamma(a + h) - 2 * math.lgamma(a) + math.lgamma(a - h)) / (h * h)
                step = (math.log(a) - digamma - gap) / (1 / a - trigamma)
                a = max(a / 2, a - step)
                if abs(step) < 1e-9 * a:
                    break
            fits.append(("gamma", 2, n * ((a - 1) * s["ml"] - a - math.lgamma(a) - a * math.log(m / a))))
    cost = 2.0 if criterion == "aic" else math.log(n)
    return sorted(({"family": f, "log_likelihood": ll, criterion: cost * k - 2 * ll} for f, k, ll in fits), key=lambda r: r[criterion])


def _log_density(family: str, p: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    lg = np.vectorize(math.lgamma, otypes=[float])
    ok = {
        "gaussian": (2, lambda: p[1] > 0), "poisson": (1, lambda: p[0] > 0), "binomial": (2, lambda: p[0] >= 0 and 0 <= p[1] <= 1), "exponential": (1, lambda: p[0] > 0),
        "geometric": (1, lambda: 0 < p[0] <= 1), "gamma": (2, lambda: p[0] > 0 and p[1] > 0), "log_normal": (2, lambda: p[1] > 0),
    }
    if family not in ok:
        raise ValueError(f"no such family: {family}")
    if len(p) < ok[family][0] or not ok[family][1]():
        raise ValueError(f"no such parameters of {family}: {list(p)}")
    whole = lambda x: (x >= 0) & (x == np.floor(x))
    log = lambda v: math.log(v) if v > 0 else -math.inf

    def f(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            if family == "gaussian":
                return -((x - p[0]) ** 2) / (2 * p[1] ** 2) - math.log(p[1] * math.sqrt(2 * math.pi))
            if family == "exponential":
                return np.where(x >= 0, math.log(p[0]) - p[0] * x, -np.inf)
            if family in ("gamma", "log_normal"):
                y = np.where(x > 0, x, 1.0)
                inside = p[0] * math.log(p[1]) - math.lgamma(p[0]) + (p[0] - 1) * np.log(y) - p[1] * y if family == "gamma" else -((np.log(y) - p[0]) ** 2) / (2 * p[1] ** 2) - np.log(y * p[1] * math.sqrt(2 * math.pi))
                return np.where(x > 0, inside, -np.inf)
            y = np.where(whole(x), x, 0.0)
            if family == "poisson":
                inside = y * math.log(p[0]) - p[0] - lg(y + 1)
            elif family == "geometric":
                inside = log(p[0]) + np.where(y > 0, y * log(1 - p[0]), 0.0)
            else:
                y = np.minimum(y, p[0])
                inside = lg(p[0] + 1.0) - lg(y + 1) - lg(p[0] - y + 1) + np.where(y > 0, y * log(p[1]), 0.0) + np.where(p[0] - y > 0, (p[0] - y) * log(1 - p[1]), 0.0)
                return np.where(whole(x) & (x <= p[0]), inside, -np.inf)
            return np.where(whole(x), inside, -np.inf)

    return f


def density(df: DataFrame, column: str, family: str, parameters: Sequence[float], out: str = "density") -> DataFrame:
    """Rows with a known value, with a family's density (or probability) there: gaussian (mean, sd), poisson (rate), binomial (size, share), exponential (rate), geometric (share), gamma (shape, rate), log_normal (mean and sd of the logarithm)."""
    f = _log_density(family, parameters)
    at = F.pandas_udf(lambda x: pd.Series(np.exp(f(x.to_numpy(dtype=float)))), "double")
    return df.where(F.col(column).isNotNull()).withColumn(out, at(F.col(column).cast("double")))


def random_numbers(spark: SparkSession, family: str, n: int, parameters: Sequence[float], seed: int = 0, block: int = 100_000) -> DataFrame:
    """(id, value): n numbers of a family, the same on every run: each block of ids has a generator of its own, seeded by the block."""
    _log_density(family, parameters)
    if n <= 0:
        raise ValueError("n must be positive")
    p = list(parameters)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                rng, size = np.random.default_rng([seed, int(k)]), min(block, n - int(k) * block)
                x = {
                    "gaussian": lambda: rng.normal(p[0], p[1], size), "poisson": lambda: rng.poisson(p[0], size), "binomial": lambda: rng.binomial(int(p[0]), p[1], size), "exponential": lambda: rng.exponential(1 / p[0], size),
                    "geometric": lambda: rng.geometric(p[0], size) - 1, "gamma": lambda: rng.gamma(p[0], 1 / p[1], size), "log_normal": lambda: rng.lognormal(p[0], p[1], size),
                }[family]()
                yield pd.DataFrame({"id": int(k) * block + np.arange(size), "value": x.astype(float)})

    blocks = -(-n // block)
    return spark.range(0, blocks, 1, min(blocks, 2000)).mapInPandas(draw, "id long, value double")


def group_ranks(df: DataFrame, column: str, group: str) -> DataFrame:
    """(group, x, n, ties, rank): how often each group has each distinct value, how often all have it, and its mean rank."""
    known = stored(df.where(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n")))
    return known.join(ranks_of_counts(known.groupBy("x").agg(F.sum("n").alias("ties"))), "x")


def kruskal_wallis(df: DataFrame, column: str, group: str) -> DataFrame:
    """One row: h (corrected for ties), df, n."""
    r = group_ranks(df, column, group)
    g = r.groupBy(group).agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n"))
    ties = r.select("x", "ties").distinct().agg(F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).alias("t"))
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").cast("double").alias("n"), (F.count(F.lit(1)) - 1).alias("df")).crossJoin(ties)  # one row each
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return s.select(h.alias("h"), "df", n.cast("long").alias("n"))


def group_means(df: DataFrame, column: str, group: str, level: float = 0.95) -> DataFrame:
    """Per group: n, mean, sd, and the t interval of the mean."""
    g = df.where(F.col(column).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    # k distinct sizes take k * k / 2 rows or more, so their table is always small
    sizes = g.where("n > 1").select("n").distinct().withColumn("t", _per_value(lambda n: t_quantile((1 + level) / 2, n - 1))("n"))
    half = F.col("t") * F.col("sd") / F.sqrt("n")
    return g.join(F.broadcast(sizes), "n", "left").select(group, "n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def effect_sizes(df: DataFrame, column: str, group: str) -> DataFrame:
    """Cohen's d (pooled sd) and Welch's t of each two groups."""
    g = df.where(F.col(column).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v"))
    a = g.select(*[F.col(c).alias(f"{c}1") for c in ("n", "m", "v")], F.col(group).alias("group1"))
    b = g.select(*[F.col(c).alias(f"{c}2") for c in ("n", "m", "v")], F.col(group).alias("group2"))
    p = a.join(b, F.col("group1") < F.col("group2"))  # a row per pair of groups
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return p.select("group1", "group2", ((F.col("m1") - F.col("m2")) / pooled).alias("cohen_d"), ((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("welch_t"))


def two_sample_t(df: DataFrame, column: str, group: str) -> dict[str, float]:
    """Welch's t, its degrees of freedom and p for the two groups of a column."""
    g = df.where(F.col(column).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v")).orderBy(group).limit(3).collect()
    if len(g) != 2:
        raise ValueError("exactly two groups are needed")
    a, b = (r["v"] / r["n"] for r in g)
    t = (g[0]["m"] - g[1]["m"]) / math.sqrt(a + b)
    d = (a + b) ** 2 / (a * a / (g[0]["n"] - 1) + b * b / (g[1]["n"] - 1))
    return {"t": t, "df": d, "p": 2 * (1 - t_cdf(abs(t), d))}


def cronbach_alpha(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """One row: the raw reliability of a scale, from one aggregate; any unknown item makes it null."""
    k = len(items)
    total = sum((F.col(i) for i in items[1:]), F.col(items[0]))
    alpha = k / (k - 1) * (1 - sum((F.var_samp(i) for i in items[1:]), F.var_samp(items[0])) / F.var_samp(total))
    unknown = sum((F.count_if(F.col(i).isNull()) for i in items[1:]), F.count_if(F.col(items[0]).isNull()))
    return df.agg(F.when(unknown == 0, alpha).alias("alpha"))


def mediation(df: DataFrame, x: str, m: str, y: str) -> DataFrame:
    """One row: paths a (m on x), b and c (y on m and x), the indirect effect a b and the total, from one covariance aggregate."""
    d = df.dropna(subset=[x, m, y])
    v = d.agg(F.var_samp(x).alias("xx"), F.var_samp(m).alias("mm"), F.covar_samp(x, m).alias("xm"), F.covar_samp(x, y).alias("xy"), F.covar_samp(m, y).alias("my"))
    det = F.col("xx") * F.col("mm") - F.col("xm") * F.col("xm")
    v = v.withColumn("a", F.col("xm") / F.col("xx")).withColumn("b", (F.col("xx") * F.col("my") - F.col("xm") * F.col("xy")) / det).withColumn("c", (F.col("mm") * F.col("xy") - F.col("xm") * F.col("my")) / det)
    return v.select("a", "b", "c", (F.col("a") * F.col("b")).alias("indirect"), (F.col("c") + F.col("a") * F.col("b")).alias("total"))


def least_squares(df: DataFrame, y: str, x: Sequence[str]) -> dict[str, object]:
    """Coefficients (intercept first), standard errors and fit figures of a linear model, from one aggregate of products.

    Figures that aren't defined (no spare rows, an exact fit, a constant ``y``) are None; without a complete row it raises ValueError.
    """
    names = ["1", *x]
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    k = len(cols)
    d = df.dropna(subset=[y, *x])
    s = d.agg(*[F.sum(cols[i] * cols[j]).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    if s["0_0"] is None:
        raise ValueError("no complete rows")
    g = np.array([[s[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n, p = int(g[0, 0]), k - 1
    inv = np.linalg.pinv(g[:p, :p])
    beta = inv @ g[:p, p]
    rss = max(0.0, float(g[p, p] - beta @ g[:p, p]))
    tss = float(g[p, p] - g[0, p] ** 2 / n)
    s2 = rss / (n - p) if n > p else None
    se = [None] * p if s2 is None else np.sqrt(np.maximum(0, np.diag(inv)) * s2).tolist()
    ll = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else None
    fstat = (tss - rss) / max(p - 1, 1) / s2 if s2 else None
    return {
        "coefficients": dict(zip(names, beta.tolist(), strict=True)), "standard_errors": dict(zip(names, se, strict=True)), "n": n, "mse": rss / n, "rmse": math.sqrt(rss / n),
        "r2": 1 - rss / tss if tss > 0 else None, "adjusted_r2": 1 - s2 / (tss / (n - 1)) if s2 is not None and tss > 0 else None,
        "aic": None if ll is None else 2 * (p + 1) - 2 * ll, "bic": None if ll is None else math.log(n) * (p + 1) - 2 * ll,
        "f": fstat, "p": 1 - f_cdf(fstat, p - 1, n - p) if p > 1 and fstat is not None else None,
    }


def residual_summary(df: DataFrame, y: str, x: Sequence[str], order: str) -> DataFrame:
    """One row: mean, median, extremes and sd of a linear model's residuals, their mean size, and Durbin-Watson's statistic in ``order``.

    Steps between neighbours are taken within blocks of the order, each with the row before it.
    """
    fit = least_squares(df, y, x)["coefficients"]
    guess: Column = sum((F.col(c) * fit[c] for c in x), F.lit(fit["1"]))
    r = in_blocks(numbered(df.dropna(subset=[y, *x]).select(order, (F.col(y) - guess).alias("e")), [order]), back=1)
    r = r.withColumn("step", F.col("e") - F.lag("e").over(Window.partitionBy("__block").orderBy("__rn"))).where("__own")
    median = F.lit(quantile_values(r, ["e"], (0.5,))["e"][0]).cast("double")
    return r.agg(F.avg("e").alias("mean"), F.min("e").alias("min"), F.max("e").alias("max"), F.stddev_samp("e").alias("sd"), F.avg(F.abs("e")).alias("mae"), (F.sum(F.col("step") * F.col("step")) / F.sum(F.col("e") * F.col("e"))).alias("durbin_watson")).withColumn("median", median)


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Per class: support, correct, precision, recall, f1."""
    c = df.groupBy(F.col(predicted).alias("p"), F.col(actual).alias("a")).count()
    rows = c.groupBy(F.col("p").alias("class")).agg(F.sum("count").alias("predicted"), F.sum(F.when(F.col("p") == F.col("a"), F.col("count")).otherwise(0)).alias("correct"))
    cols = c.groupBy(F.col("a").alias("class")).agg(F.sum("count").alias("support"))
    j = rows.join(cols, "class", "full").fillna(0, ["predicted", "correct", "support"])
    precision, recall = F.try_divide("correct", "predicted"), F.try_divide("correct", "support")
    return j.select("class", "support", "correct", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def area_under_curve(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the area under the ROC curve by average ranks; ``positive`` is 0 or 1."""
    r = group_ranks(df, score, positive)
    s = r.agg(F.sum(F.when(F.col(positive) == 1, F.col("n") * F.col("rank"))).alias("r"), F.sum(F.when(F.col(positive) == 1, F.col("n"))).alias("p"), F.sum(F.when(F.col(positive) == 0, F.col("n"))).alias("q"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def logistic_levels(df: DataFrame, response: str, factor: str) -> DataFrame:
    """(level, n, rate, odds_ratio): a logistic model of a 0/1 response on one factor, against its first level; from counts."""
    g = df.where(F.col(response).isNotNull() & F.col(factor).isNotNull()).groupBy(F.col(factor).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(response).cast("double")).alias("rate"))
    base = F.first("odds").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # over levels
    return g.withColumn("odds", F.try_divide(F.col("rate"), 1 - F.col("rate"))).withColumn("odds_ratio", F.try_divide(F.col("odds"), base)).drop("odds")


def logistic_deviance(df: DataFrame, response: str, factor: str) -> DataFrame:
    """One row: by how much the factor lowers the deviance of a 0/1 response, and its degrees of freedom."""
    g = logistic_levels(df, response, factor)
    part = lambda n, p: -2 * n * (F.when(p > 0, p * F.log(p)).otherwise(0) + F.when(p < 1, (1 - p) * F.log(1 - p)).otherwise(0))
    n, p = F.sum("n"), F.sum(F.col("n") * F.col("rate")) / F.sum("n")
    s = g.agg(n.alias("n"), p.alias("p"), F.sum(part(F.col("n"), F.col("rate"))).alias("residual"), (F.count(F.lit(1)) - 1).alias("df"))
    return s.select((part(F.col("n"), F.col("p")) - F.col("residual")).alias("deviance"), "df")
