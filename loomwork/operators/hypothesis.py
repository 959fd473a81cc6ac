"""Tests of normality, means, ranks and ROC curves, from aggregates and exact ranks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored
from loomwork.functions.ordered import average_ranks, running_before
from loomwork.functions.special import f_cdf, normal_cdf, t_cdf


def each(f: Callable[..., float | None]) -> Callable[..., Column]:
    """A plain function of numbers as a column function, for tables of a row per group or distinct value; null in, null out."""

    @F.pandas_udf("double")
    def one(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f(v)).astype("float64")

    @F.pandas_udf("double")
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else f(a, b) for a, b in zip(x, y, strict=True)], dtype="float64")

    return lambda *columns: (one if len(columns) == 1 else two)(*columns)


def normal_quantile(p: float) -> float:
    """The inverse of the normal distribution function, by Newton's steps from a logistic start."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    x = math.log(p / (1 - p)) / 1.702
    for _ in range(60):
        step = (normal_cdf(x) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-13:
            break
    return x


def _francia_p(w: float, n: float) -> float | None:
    # Royston's approximation of the distribution of Shapiro-Francia's W, for 5 to 5000 values.
    if n < 5 or w >= 1:
        return None
    u = math.log(n)
    v = math.log(u)
    mean, sd = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2 / u)
    return 1 - normal_cdf((math.log(1 - w) - mean) / sd)


def normality(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """(group, variable, n, w, p, a2): Shapiro-Francia's W with its p, and Anderson-Darling's A-squared, for a normal law of the group's mean and sd.

    W is the squared correlation of the ordered values with normal scores, which unlike Shapiro-Wilk's needs no
    covariances and so takes any n (p is Royston's, meant for up to 5000 values). Ranks are exact; ties share
    the sum of their places. Groups with fewer than three known values or one distinct value have null figures.
    """
    require_columns(df, [group, *columns])
    long = df.select(F.col(group).alias("group"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["group"], list(columns), "variable", "x").where("x is not null")
    s = stored(long.groupBy("group", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s")))
    counts = long.groupBy("group", "variable", "x").agg(F.count(F.lit(1)).alias("k"))
    places = running_before(counts, ["x"], "k", ["group", "variable"])
    named = s.withColumnsRenamed({"group": "__g", "variable": "__v"})
    d = places.join(named, places["group"].eqNullSafe(named["__g"]) & (places["variable"] == named["__v"])).drop("__g", "__v").where("n >= 3 and s > 0")
    cdf = each(lambda z: min(1 - 1e-16, max(1e-300, normal_cdf(z))))
    # ties take the score of their mean place; for A-squared the sum of (2 i - 1) over their places
    middle = F.col("before") + (F.col("k") + 1) / 2
    d = d.withColumn("score", each(normal_quantile)((middle - 0.375) / (F.col("n") + 0.25))).withColumn("below", cdf((F.col("x") - F.col("m")) / F.col("s"))).withColumn("above", cdf((F.col("m") - F.col("x")) / F.col("s")))
    k, b, n = F.col("k").cast("double"), F.col("before").cast("double"), F.col("n").cast("double")
    odd = 2 * b * k + k * k
    term = odd * F.log("below") + (2 * n * k - odd) * F.log("above")
    moments = [(k * F.col("x") * F.col("score"), "xs"), (k * F.col("score"), "ss"), (k * F.col("score") * F.col("score"), "s2"), (k * (F.col("x") - F.col("m")) * F.col("score"), "cs")]
    g = d.groupBy("group", "variable").agg(F.max("n").alias("n"), F.max("s").alias("sd"), *[F.sum(e).alias(a) for e, a in moments], F.sum(term).alias("t"))
    spread = F.col("s2") - F.col("ss") * F.col("ss") / F.col("n")
    w = F.col("cs") * F.col("cs") / (spread * F.col("sd") * F.col("sd") * (F.col("n") - 1))
    g = g.select(F.col("group").alias("__g"), F.col("variable").alias("__v"), w.alias("w"), (-F.col("n") - F.col("t") / F.col("n")).alias("a2"))
    out = s.join(g, s["group"].eqNullSafe(g["__g"]) & (s["variable"] == g["__v"]), "left")
    return out.select(F.col("group").alias(group), "variable", "n", "w", each(_francia_p)("w", "n").alias("p"), "a2")


def _moments(df: DataFrame, column: str, group: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v"))


def welch_anova(df: DataFrame, column: str, group: str) -> DataFrame:
    """One row: Welch's F, its degrees of freedom and p for equal means of groups of unequal variance; groups of one row, or of no variance, are left out."""
    g = _moments(df, column, group).where("n > 1 and v > 0").withColumn("w", F.col("n") / F.col("v"))
    s = g.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("m")).alias("wm"), F.count(F.lit(1)).alias("k")).withColumn("mean", F.col("wm") / F.col("w"))
    d = g.select("n", "m", F.col("w").alias("wi")).crossJoin(F.broadcast(s))  # one row
    share = 1 - F.col("wi") / F.col("w")
    t = d.agg(F.sum(F.col("wi") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"), F.sum(share * share / (F.col("n") - 1)).alias("l"), F.max("k").cast("double").alias("k"))
    k = F.col("k")
    f = F.col("between") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("l"))
    t = t.where("k > 1").select(f.alias("f"), (k - 1).alias("df1"), ((k * k - 1) / (3 * F.col("l"))).alias("df2"))
    tail = F.pandas_udf(lambda f, a, b: pd.Series([1 - f_cdf(x, y, z) for x, y, z in zip(f, a, b, strict=True)], dtype="float64"), "double")
    return t.withColumn("p", tail("f", "df1", "df2"))


def pairwise_t(df: DataFrame, column: str, group: str) -> DataFrame:
    """(group1, group2, t, df, p, p_adjusted): Welch's t of each two groups, with Bonferroni's adjustment; a row per pair of groups of two rows or more."""
    g = stored(_moments(df, column, group).where("n > 1 and group is not null"))
    a, b = (g.select(*[F.col(c).alias(f"{c}{k}") for c in ("group", "n", "m", "v")]) for k in (1, 2))
    p = a.join(b, F.col("group1") < F.col("group2"))  # a row per pair is the result
    x, y = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    p = p.select("group1", "group2", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(x + y)).alias("t"), F.try_divide((x + y) * (x + y), x * x / (F.col("n1") - 1) + y * y / (F.col("n2") - 1)).alias("df"))
    p = p.withColumn("p", each(lambda t, d: 2 * (1 - t_cdf(abs(t), d)))("t", "df"))
    pairs = g.count() * (g.count() - 1) // 2
    return p.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * pairs))


def _placements(df: DataFrame, score: str, positive: str, out: str) -> DataFrame:
    """``df`` with ``out``: the share of the other class that a row's score beats, ties counting half."""
    overall = average_ranks(df, score).select(F.col("x").alias("__x"), F.col("rank").alias("__all"))
    sides = []
    for side in (0, 1):
        own = average_ranks(df.where(F.col(positive) == side), score).select(F.col("x").alias("__y"), F.col("rank").alias("__own"))
        d = df.where(F.col(positive) == side)
        d = d.join(overall, d[score] == overall["__x"]).join(own, F.col("__x") == F.col("__y"))
        sides.append(d.withColumn(out, F.col("__all") - F.col("__own")).drop("__x", "__y", "__all", "__own"))
    return sides[0].unionByName(sides[1])


def compare_roc(df: DataFrame, first: str, second: str, positive: str) -> DataFrame:
    """One row: the areas under two scores' ROC curves on the same rows, their standard errors, z and p of the difference (DeLong's test).

    ``positive`` is 0 or 1. Rows that lack either score are left out. Everything comes from exact average ranks.
    """
    d = stored(df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(positive).isin(0, 1)).select(F.col(first).alias("a"), F.col(second).alias("b"), F.col(positive).cast("int").alias("y")))
    d = stored(_placements(stored(_placements(d, "a", "y", "pa")), "b", "y", "pb"))
    g = d.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("pa").alias("ma"), F.avg("pb").alias("mb"), F.var_samp("pa").alias("va"), F.var_samp("pb").alias("vb"), F.covar_samp("pa", "pb").alias("c"))
    pick = lambda c, y: F.max(F.when(F.col("y") == y, F.col(c)))
    s = g.agg(*[pick(c, y).alias(f"{c}{y}") for c in ("n", "ma", "mb", "va", "vb", "c") for y in (0, 1)])
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    var = lambda c: F.col(f"{c}1") / (n0 * n0) / n1 + F.col(f"{c}0") / (n1 * n1) / n0
    s = s.select((F.col("ma1") / n0).alias("auc1"), (F.col("mb1") / n0).alias("auc2"), F.sqrt(var("va")).alias("se1"), F.sqrt(var("vb")).alias("se2"), (var("va") + var("vb") - 2 * var("c")).alias("v"))
    s = s.withColumn("z", F.try_divide(F.col("auc1") - F.col("auc2"), F.sqrt(F.greatest("v", F.lit(0.0)))))
    return s.select("auc1", "auc2", "se1", "se2", "z", each(lambda z: 2 * (1 - normal_cdf(abs(z))))("z").alias("p"))


def bootstrap_rank_tests(df: DataFrame, column: str, positive: str, id_col: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """(replicate, auc, p): the area under the curve and the rank-sum test's p of each resampled table, rows drawn with Poisson(1) weights by a hash.

    Weights are summed per replicate, class and distinct value where the rows are; ranks follow from running totals per replicate.
    p is the normal approximation, corrected for ties and continuity.
    """
    u = F.pmod(F.xxhash64(id_col, "replicate", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()
    d = df.where(F.col(column).isNotNull() & F.col(positive).isin(0, 1)).select(id_col, F.col(column).cast("double").alias("x"), F.col(positive).cast("int").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    d = d.withColumn("w", sum(((u >= c).cast("int") for c in cuts), F.lit(0))).where("w > 0")
    counts = d.groupBy("replicate", "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("w1"))
    r = running_before(counts, ["x"], "w", ["replicate"]).withColumn("rank", F.col("before") + (F.col("w") + 1) / 2)
    w = F.col("w").cast("double")
    g = r.groupBy("replicate").agg(F.sum(F.col("w1") * F.col("rank")).alias("r1"), F.sum("w1").cast("double").alias("n1"), F.sum(F.col("w") - F.col("w1")).cast("double").alias("n0"), F.sum(w * w * w - w).alias("t"))
    n = F.col("n0") + F.col("n1")
    big_u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n0") * F.col("n1") / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    away = F.greatest(F.abs(big_u - F.col("n0") * F.col("n1") / 2) - 0.5, F.lit(0.0))
    g = g.select("replicate", F.try_divide(big_u, F.col("n0") * F.col("n1")).alias("auc"), F.try_divide(away, sd).alias("z"))
    return g.select("replicate", "auc", each(lambda z: 2 * (1 - normal_cdf(z)))("z").alias("p"))


def bootstrap_figures(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row of resampled tests: the share of p below ``alpha``, and the central 95 % of -log2 p and of the areas (a value per replicate)."""
    strength = -F.log2(F.greatest("p", F.lit(1e-300)))
    both = F.array(F.lit(0.025), F.lit(0.975))
    s = tests.agg(F.avg((F.col("p") < alpha).cast("double")).alias("proportion"), F.percentile(strength, both).alias("s"), F.percentile("auc", both).alias("a"))
    return s.select("proportion", F.get("s", F.lit(0)).alias("lower_bound"), F.get("s", F.lit(1)).alias("upper_bound"), F.get("a", F.lit(0)).alias("auc_low"), F.get("a", F.lit(1)).alias("auc_high"))


def bayes_factor(df: DataFrame, column: str, group: str, scale: float = math.sqrt(2) / 2, form: str = "bf") -> float:
    """How much better two groups' values are explained with a difference of means than without: the JZS factor (``bf``), or its logarithm (``logbf``).

    One aggregate gives the pooled t; one integral over the prior's variance gives the factor. Unknown values are refused,
    and so are other numbers of groups than two.
    """
    if df.where(F.col(column).isNull() | F.col(group).isNull()).limit(1).count():
        raise ValueError("unknown values")
    rows = _moments(df, column, group).limit(3).collect()
    if len(rows) != 2:
        raise ValueError("exactly two groups are needed")
    (n1, m1, v1), (n2, m2, v2) = ((r["n"], r["m"], r["v"] or 0.0) for r in rows)
    free = n1 + n2 - 2
    t2 = (m1 - m2) ** 2 / (((n1 - 1) * v1 + (n2 - 1) * v2) / free * (1 / n1 + 1 / n2))
    n = n1 * n2 / (n1 + n2)
    y = np.linspace(-30, 40, 40_001)  # log of the prior's variance
    g = np.exp(y)
    a = 1 + n * g * scale * scale
    log_f = -0.5 * np.log(a) - (free + 1) / 2 * np.log1p(t2 / (a * free)) - 0.5 * math.log(2 * math.pi) - 0.5 * y - 1 / (2 * g) + (free + 1) / 2 * math.log1p(t2 / free)
    top = log_f.max()
    out = top + math.log(float(np.sum(np.exp(log_f - top))) * (y[1] - y[0]))
    return out if form == "logbf" else math.exp(out)
