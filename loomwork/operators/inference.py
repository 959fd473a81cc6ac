"""Multivariate and resampling methods: sums over all rows on Spark, small matrices on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import stored
from loomwork.functions.special import chi2_cdf, normal_cdf
from loomwork.operators.statistics import group_ranks


def class_scatter(df: DataFrame, target: str, features: Sequence[str]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """(rows, mean, sums of products about the mean) of each class, from one aggregate; at most 1000 classes."""
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    d = df.dropna(subset=[target, *features])
    g = d.groupBy(target).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs])
    rows = g.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 classes")
    out = {}
    for r in rows:
        s = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) * r["n"]
        out[r[target]] = (r["n"], np.array([r[f"m{i}"] for i in range(p)]), s)
    return out


def discriminant_axes(df: DataFrame, target: str, features: Sequence[str]) -> np.ndarray:
    """Fisher's axes as columns, the most telling first, scaled to unit within-class variance; classes of one row are left out."""
    groups = {k: v for k, v in class_scatter(df, target, features).items() if v[0] > 1}
    if len(groups) < 2:
        raise ValueError("at least two classes of two rows are needed")
    n = sum(v[0] for v in groups.values())
    mean = sum(v[0] * v[1] for v in groups.values()) / n
    within = sum(v[2] for v in groups.values()) / (n - len(groups))
    between = sum(v[0] * np.outer(v[1] - mean, v[1] - mean) for v in groups.values())
    values, vectors = np.linalg.eigh(within)
    white = vectors / np.sqrt(np.maximum(values, 1e-12))
    _, axes = np.linalg.eigh(white.T @ between @ white)
    axes = (white @ axes[:, ::-1])[:, : min(len(features), len(groups) - 1)]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def discriminant_scores(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """``df`` with ``ld1``, ``ld2``...: its projections on Fisher's axes."""
    axes = discriminant_axes(df, target, features)
    return df.withColumns({f"ld{k + 1}": sum((F.col(c) * float(axes[i, k]) for i, c in enumerate(features)), F.lit(0.0)) for k in range(axes.shape[1])})


def box_m(df: DataFrame, target: str, features: Sequence[str]) -> dict[str, float]:
    """Box's M for equal covariances, its chi-square and p."""
    groups = class_scatter(df, target, features)
    g, p, n = len(groups), len(features), sum(v[0] for v in groups.values())
    pooled = sum(v[2] for v in groups.values()) / (n - g)
    logdet = lambda a: np.linalg.slogdet(a)[1]
    m = (n - g) * logdet(pooled) - sum((v[0] - 1) * logdet(v[2] / (v[0] - 1)) for v in groups.values())
    c = (sum(1 / (v[0] - 1) for v in groups.values()) - 1 / (n - g)) * (2 * p * p + 3 * p - 1) / (6 * (p + 1) * (g - 1))
    chi2, d = m * (1 - c), p * (p + 1) * (g - 1) / 2
    return {"m": float(m), "chi2": float(chi2), "df": d, "p": 1 - chi2_cdf(float(chi2), d)}


def factor_loadings(df: DataFrame, features: Sequence[str], factors: int, rounds: int = 200) -> np.ndarray:
    """Principal-axis loadings of the correlation matrix (one aggregate), turned by varimax."""
    p = len(features)
    d = df.dropna(subset=list(features))
    s = d.agg(*[F.corr(features[i], features[j]).alias(f"r{i}_{j}") for i, j in combinations(range(p), 2)]).first()
    r = np.eye(p)
    for i, j in combinations(range(p), 2):
        r[i, j] = r[j, i] = s[f"r{i}_{j}"]
    shared = 1 - 1 / np.diag(np.linalg.inv(r))
    for _ in range(rounds):
        reduced = r.copy()
        np.fill_diagonal(reduced, shared)
        values, vectors = np.linalg.eigh(reduced)
        loads = vectors[:, ::-1][:, :factors] * np.sqrt(np.maximum(values[::-1][:factors], 0))
        new = (loads**2).sum(1)
        if np.abs(new - shared).max() < 1e-8:
            break
        shared = np.minimum(new, 1.0)
    turn = np.eye(factors)
    for _ in range(rounds):
        x = loads @ turn
        u, _, vt = np.linalg.svd(loads.T @ (x**3 - x * (x**2).mean(0)))
        if np.allclose(u @ vt, turn, atol=1e-10):
            break
        turn = u @ vt
    return loads @ turn


def dunn_table(df: DataFrame, column: str, group: str) -> DataFrame:
    """(group1, group2, z, p, p_adjusted): Dunn's z of each two groups after ranks over all, corrected for ties, with p and its Benjamini-Hochberg adjustment.

    A row per pair of groups, whatever their number; pairs are ranked by p within ranges of p.
    """
    r = group_ranks(df, column, group)
    g = stored(r.groupBy(group).agg((F.sum(F.col("n") * F.col("rank")) / F.sum("n")).alias("m"), F.sum("n").alias("n")))
    ties, n = r.select("x", "ties").distinct().agg(F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")), F.sum("ties")).first()
    spread = n * (n + 1) / 12 - ties / (12 * (n - 1)) if n and n > 1 else None

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.abs().map(lambda v: 2 * (1 - normal_cdf(v))).astype("float64")

    a, b = (g.select(F.col(group).alias(f"group{k}"), F.col("m").alias(f"m{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    z = (F.col("m1") - F.col("m2")) / F.sqrt(F.lit(spread).cast("double") * (1 / F.col("n1") + 1 / F.col("n2")))
    each = (F.col("group1") < F.col("group2")) | (F.col("group1").isNull() & F.col("group2").isNotNull())  # null is a group, the first
    pairs = stored(a.join(b, each).select("group1", "group2", z.alias("z")).withColumn("p", two_sided("z")))
    # equal p are in one range; its place is kept, since a read table has other partitions
    ranges = stored(pairs.repartitionByRange("p").withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(Window.partitionBy()).alias("__all"))
    inside = Window.partitionBy("__range")
    ranked = ranges.join(F.broadcast(starts), "__range").withColumn("__rank", F.col("__start") + F.row_number().over(inside.orderBy("p", "group1", "group2")))
    ranked = stored(ranked.withColumn("__q", F.col("p") * F.col("__all") / F.col("__rank")))
    later = ranked.groupBy("__range").agg(F.min("__q").alias("__q")).select("__range", F.min("__q").over(after).alias("__later"))
    own = F.min("__q").over(inside.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.join(F.broadcast(later), "__range").select("group1", "group2", "z", "p", F.least(own, "__later", F.lit(1.0)).alias("p_adjusted"))


def dunn_pairs(df: DataFrame, column: str, group: str) -> list[dict[str, object]]:
    """The rows of ``dunn_table`` in order of the groups; more than 500,000 pairs (1,000 groups) are refused, not cut: take the table."""
    rows = dunn_table(df, column, group).limit(500_001).collect()
    if len(rows) > 500_000:
        raise ValueError("more than 500000 pairs of groups; dunn_table has them all")
    return sorted((r.asDict() for r in rows), key=lambda r: (r["group1"] is not None, r["group1"], r["group2"]))


def bootstrap_means(df: DataFrame, column: str, group: str, id_col: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(group, replicate, mean): means of rows drawn with Poisson(1) weights that a hash of id and replicate gives.

    Sums are formed where the rows are; what moves is a row per task, group and replicate.
    """
    u = F.pmod(F.xxhash64(id_col, "replicate", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    cuts, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)
    weight = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    d = df.where(F.col(column).isNotNull()).select(group, id_col, F.col(column).cast("double").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    return d.withColumn("w", weight).groupBy(group, "replicate").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def bootstrap_intervals(means: DataFrame, group: str, level: float = 0.95) -> DataFrame:
    """Percentile intervals of bootstrap means."""
    q = F.percentile("mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return means.groupBy(group).agg(F.avg("mean").alias("mean"), q.alias("q")).select(group, "mean", F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def _isolation_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) < 2 or (x == x[0]).all():
        n = len(x)
        return (0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n,)
    spread = np.flatnonzero(x.max(0) > x.min(0))
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] <= cut
    return (f, cut, _isolation_tree(x[low], rng, depth - 1), _isolation_tree(x[~low], rng, depth - 1))


def _depths(tree: tuple, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += depth + tree[0]
        return
    low = x[at, tree[0]] <= tree[1]
    for part, branch in ((at[low], tree[2]), (at[~low], tree[3])):
        if len(part):
            _depths(branch, x, part, depth + 1, out)


def isolation_scores(df: DataFrame, columns: Sequence[str], id_col: str, trees: int = 50, sample: int = 256, seed: int = 0) -> DataFrame:
    """``df`` with ``isolation_score``, near 1 for rows that random cuts isolate soon.

    Trees are grown on the driver from samples out of at most ``trees`` x ``sample`` rows, those of the least hashed ids;
    every row is scored. Rows with an unknown value have a null score.
    """
    known = df.dropna(subset=list(columns))
    rows = known.select(F.xxhash64(id_col, F.lit(seed)).alias("h"), *[F.col(c).cast("double") for c in columns]).orderBy("h").limit(trees * sample).collect()
    x, rng = np.array([tuple(r)[1:] for r in rows], dtype=float).reshape(len(rows), len(columns)), np.random.default_rng(seed)
    n = min(sample, len(x))
    forest = [_isolation_tree(x[rng.choice(len(x), n, replace=False)], rng, math.ceil(math.log2(max(n, 2)))) for _ in range(trees)] if n else []
    usual = _isolation_tree(np.zeros((max(n, 2), 1)), rng, 0)[0]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            v = np.array([[np.nan if a is None else a for a in r] for r in vectors], dtype=float).reshape(len(vectors), -1)
            out, fine = np.zeros(len(v)), np.flatnonzero(~np.isnan(v).any(1))
            for t in forest:
                _depths(t, v, fine, 0, out)
            s = pd.Series(2.0 ** (-out / max(len(forest), 1) / usual))
            s[np.isnan(v).any(1)] = None
            yield s

    return df.withColumn("isolation_score", score(F.array(*[F.col(c).cast("double") for c in columns])))
