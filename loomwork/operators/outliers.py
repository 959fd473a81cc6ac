"""Outlier flags: 1 outlying, 0 not, null unknown."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import stored
from loomwork.functions.ordered import quantile_values
from loomwork.functions.special import chi2_quantile, t_quantile
from loomwork.operators.inference import isolation_scores
from loomwork.operators.neighbours import nearest_rows
from loomwork.operators.robust import elliptic_flags, one_class_flags

#: About so many points of a cell are compared in one task.
CELL_ROWS = 4096


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(stats))  # one row


def z_flags(df: DataFrame, column: str, limit: float = 1.96, out: str = "outlier") -> DataFrame:
    """Further than ``limit`` standard deviations from the mean; a constant column has none."""
    s = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    flag = F.when(F.col(column).isNull(), None).when(F.col("__s") == 0, 0).otherwise((F.abs((F.col(column) - F.col("__m")) / F.col("__s")) > limit).cast("int"))
    return _with_stats(df, s).withColumn(out, flag).drop("__m", "__s")


def tukey_flags(df: DataFrame, column: str, multiplier: float = 1.5, out: str = "outlier") -> DataFrame:
    """Beyond the quartiles by more than ``multiplier`` interquartile ranges."""
    lo, hi = quantile_values(df, [column], (0.25, 0.75))[column]
    if lo is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    outside = (F.col(column) < lo - multiplier * (hi - lo)) | (F.col(column) > hi + multiplier * (hi - lo))
    return df.withColumn(out, outside.cast("int"))


def _median_deviation(df: DataFrame, column: str) -> tuple[Column, Column]:
    """The median and the median distance from it, nulls where nothing is known."""
    m = quantile_values(df, [column], (0.5,))[column][0]
    d = quantile_values(df, {column: F.abs(F.col(column) - m)}, (0.5,))[column][0] if m is not None else None
    return F.lit(m).cast("double"), F.lit(d).cast("double")


def mad_flags(df: DataFrame, column: str, multiplier: float = 3.0, out: str = "outlier") -> DataFrame:
    """Further than ``multiplier`` median deviations (unscaled) from the median; where that is 0, anything off the median."""
    m, d = _median_deviation(df, column)
    away = F.abs(F.col(column) - m)
    return df.withColumn(out, F.when(d == 0, away > 0).otherwise(away > multiplier * d).cast("int"))


def modified_z_flags(df: DataFrame, column: str, limit: float = 3.5, out: str = "outlier") -> DataFrame:
    """0.6745 x deviation / (1.4826 x median deviation) above ``limit``; the double scaling is kept as the method has it. Where that is 0, anything off the median."""
    m, d = _median_deviation(df, column)
    score = 0.6745 * F.abs(F.col(column) - m) / (1.4826 * d)
    return df.withColumn(out, F.when(d != 0, score > limit).otherwise(F.col(column) != m).cast("int"))


def grubbs_limit(n: int, alpha: float = 0.05) -> float:
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def grubbs_flags(df: DataFrame, column: str, alpha: float = 0.05, out: str = "outlier") -> DataFrame:
    """Standard scores above Grubbs' limit for the number of known values; null below three values."""
    n = df.where(F.col(column).isNotNull()).count()
    if n < 3:
        return df.withColumn(out, F.lit(None).cast("int"))
    return z_flags(df, column, grubbs_limit(n, alpha), out)


def mahalanobis_flags(df: DataFrame, columns: Sequence[str], level: float = 0.95, out: str = "outlier") -> DataFrame:
    """Squared distance by the sample covariance of complete rows beyond the chi-square quantile; null in incomplete rows."""
    p = len(columns)
    full = df.dropna(subset=list(columns))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    s = full.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if s["n"] < 2:
        return df.withColumn(out, F.lit(None).cast("int"))
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    inv = np.linalg.pinv(cov)
    x = [F.col(c) - s[f"m{i}"] for i, c in enumerate(columns)]
    d2: Column = sum((x[i] * x[j] * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    return df.withColumn("distance2", d2).withColumn(out, (F.col("distance2") > chi2_quantile(level, p)).cast("int"))


def _cells(df: DataFrame, columns: Sequence[str], eps: float) -> DataFrame:
    return df.withColumn("__cell", F.array(*[F.floor(F.col(c) / eps).cast("long") for c in columns]))


def _squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def noise_flags(df: DataFrame, id_col: str, columns: Sequence[str], eps: float = 0.5, min_points: int = 5, out: str = "outlier") -> DataFrame:
    """Points without a dense point within ``eps`` (a dense one has ``min_points`` or more there, itself included).

    Equal points are one row with a count. All points of a cell with a diagonal of ``eps`` are neighbours; so in one that holds
    ``min_points`` all are dense, and none is compared. Only the others ask, in their own and adjoining cells of side ``eps``: of them
    a cell has a bounded number, whatever its density, so the work is linear. Cells of many points are dealt to tasks in blocks.
    Rows with a null or NaN have a null flag.
    """
    known = df.dropna(subset=list(columns))
    side = eps / math.sqrt(len(columns)) * (1 - 1e-9)
    points = known.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    points = stored(_cells(points, columns, eps).withColumn("__small", F.array(*[F.floor(F.col(c) / side).cast("long") for c in columns])))
    full = points.groupBy("__small").agg(F.sum("__n").alias("__t")).where(F.col("__t") >= min_points).select("__small", F.lit(True).alias("__full"))
    points = stored(points.join(full, "__small", "left").withColumn("__full", F.coalesce("__full", F.lit(False))).drop("__small"))
    crowded = stored(points.groupBy("__cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("__blocks")).where("__blocks > 1"))
    blocks = F.coalesce("__blocks", F.lit(1))
    others = {c: f"__o_{c}" for c in columns}
    home = points.join(crowded, "__cell", "left").withColumn("__block", F.pmod(F.xxhash64(*columns), blocks).cast("int"))
    home = home.select("__cell", "__block", *[F.col(c).alias(o) for c, o in others.items()], F.col("__n").alias("__on"), F.col("__full").alias("__ofull"))
    near = points.where("not __full").select(*columns, F.col("__cell").alias("__own"))
    for i in range(len(columns)):
        near = near.withColumn(f"__k{i}", F.explode(F.array(*[F.get("__own", i) + s for s in (-1, 0, 1)])))
    near = near.select(*columns, F.array(*[F.col(f"__k{i}") for i in range(len(columns))]).alias("__cell")).join(crowded, "__cell", "left")
    near = near.withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("__blocks")
    pairs = near.join(home, ["__cell", "__block"]).where(_squared([F.col(c) for c in columns], [F.col(o) for o in others.values()]) <= eps * eps)
    counts = stored(pairs.groupBy(*columns).agg(F.sum("__on").alias("__m"), F.max("__ofull").alias("__touched")))
    dense = counts.where(F.col("__m") >= min_points).select(*[F.col(c).alias(o) for c, o in others.items()])
    sparse = pairs.where("not __ofull").join(dense, list(others.values())).select(*columns)
    reached = points.where("__full").select(*columns).union(counts.where("__touched").select(*columns)).union(sparse).distinct().withColumn(out, F.lit(0))
    flags = known.join(reached, list(columns), "left").withColumn(out, F.coalesce(out, F.lit(1)))
    return flags.select(id_col, *columns, out).unionByName(df.join(known.select(id_col), id_col, "left_anti").select(id_col, *columns, F.lit(None).cast("int").alias(out)))


def lof_flags(df: DataFrame, id_col: str, columns: Sequence[str], min_points: int = 5, limit: float = 1.5, out: str = "outlier") -> DataFrame:
    """``lof``, the local outlier factor with k = ``min_points`` - 1 neighbours (ties at the k-th are kept), and its flag.

    Neighbours are exact, see ``nearest_rows``. Incomplete rows have null figures; ids must be unique.
    """
    near = stored(nearest_rows(df, id_col, columns, min_points - 1, ties=True))
    reach = near.groupBy("id").agg(F.max("d").alias("kd"))
    lrd = stored(near.join(reach.withColumnRenamed("id", "o"), "o").groupBy("id").agg(F.try_divide(F.count(F.lit(1)), F.sum(F.greatest("d", "kd"))).alias("lrd")))
    other = lrd.select(F.col("id").alias("o"), F.col("lrd").alias("ol"))
    lof = near.join(other, "o").join(lrd, "id").groupBy(F.col("id").alias("__id")).agg(F.try_divide(F.avg("ol"), F.first("lrd")).alias("lof"))
    return df.join(lof, df[id_col] == F.col("__id"), "left").drop("__id").withColumn(out, (F.col("lof") > limit).cast("int"))


METHODS = {"z": z_flags, "tukey": tukey_flags, "mad": mad_flags, "modified_z": modified_z_flags, "grubbs": grubbs_flags}
UNIVARIATE = ("z", "tukey", "grubbs", "mad", "iglewicz_hoaglin")
MULTIVARIATE = ("mahalanobis", "isolation_forest", "dbscan", "lof", "one_class_svm", "elliptic_envelope")


def detect_outliers(
    df: DataFrame, id_col: str, columns: Sequence[str], methods: Sequence[str] = (*UNIVARIATE, *MULTIVARIATE), z_limit: float = 1.96, multiplier: float = 1.5, alpha: float = 0.05, mad_multiplier: float = 3.0,
    score_limit: float = 3.5, level: float = 0.95, contamination: float = 0.1, eps: float = 0.5, min_points: int = 5, lof_limit: float = 1.5, nu: float = 0.05,
) -> DataFrame:
    """``df`` with ``<column>_<method>_outlier`` for each column and one-column method and ``multivariate_<method>_outlier`` for the others.

    All columns' figures come from one aggregate, one pass of quantiles and one of distances from the medians; the flags
    are then plain expressions of the row. Flags are 1, 0 or null where unknown. Isolation scores flag the
    ``contamination`` share of highest scores. Ids must be unique for the methods over several columns.
    """
    if bad := set(methods) - {*UNIVARIATE, *MULTIVARIATE}:
        raise ValueError(f"no such methods: {', '.join(sorted(bad))}")
    s = df.agg(*[a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]).first()
    q = quantile_values(df, columns, (0.25, 0.5, 0.75)) if {"tukey", "mad", "iglewicz_hoaglin"} & set(methods) else {}
    away = {c: F.abs(F.col(c) - F.lit(v[1]).cast("double")) for c, v in q.items()}
    dev = {c: v[0] for c, v in quantile_values(df, away, (0.5,)).items()} if {"mad", "iglewicz_hoaglin"} & set(methods) else {}
    number = lambda v: F.lit(v).cast("double")
    flags = {}
    for i, c in enumerate(columns):
        x, n, mean, sd = F.col(c).cast("double"), s[f"n{i}"], number(s[f"m{i}"]), number(s[f"s{i}"])
        beyond = lambda limit, x=x, mean=mean, sd=sd: F.when(x.isNull(), F.lit(None)).when(sd == 0, F.lit(False)).otherwise(F.abs((x - mean) / sd) > limit)
        for m in (m for m in UNIVARIATE if m in methods):
            if m == "z":
                flag = beyond(z_limit)
            elif m == "grubbs":
                flag = beyond(grubbs_limit(n, alpha)) if n >= 3 else F.lit(None).cast("boolean")
            elif m == "tukey":
                lo, hi = number(q[c][0]), number(q[c][2])
                flag = (x < lo - multiplier * (hi - lo)) | (x > hi + multiplier * (hi - lo))
            else:
                off, d = F.abs(x - number(q[c][1])), number(dev[c])
                flag = F.when(d == 0, off > 0).otherwise(off > mad_multiplier * d if m == "mad" else 0.6745 * off / (1.4826 * d) > score_limit)
            flags[f"{c}_{m}_outlier"] = flag.cast("int")
    out = df.withColumns(flags) if flags else df
    found = []
    for m in (m for m in MULTIVARIATE if m in methods):
        name = f"multivariate_{m}_outlier"
        if m == "mahalanobis":
            found.append(mahalanobis_flags(df.select(id_col, *columns), columns, level, name).select(id_col, name))
        elif m == "isolation_forest":
            scores = stored(isolation_scores(df.select(id_col, *columns), columns, id_col).select(id_col, "isolation_score"))
            cut = quantile_values(scores, ["isolation_score"], (1 - contamination,))["isolation_score"][0]
            found.append(scores.select(id_col, (F.col("isolation_score") > number(cut)).cast("int").alias(name)))
        elif m == "one_class_svm":
            found.append(one_class_flags(df.select(id_col, *columns), columns, nu, out=name).select(id_col, name))
        elif m == "elliptic_envelope":
            found.append(elliptic_flags(df.select(id_col, *columns), columns, contamination, name).select(id_col, name))
        elif m == "dbscan":
            found.append(noise_flags(df.select(id_col, *columns), id_col, columns, eps, min_points, name).select(id_col, name))
        else:
            found.append(lof_flags(df.select(id_col, *columns), id_col, columns, min_points, lof_limit, name).select(id_col, name))
    for f in found:
        out = out.join(f.withColumnRenamed(id_col, "__id"), F.col(id_col) == F.col("__id"), "left").drop("__id")
    return out


def standard_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: r (2 digits) and the share of each quadrant (1 digit) of standardised complete rows; 0 counts as low."""
    d = df.dropna(subset=[x, y])
    s = d.agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("__r"))
    d = _with_stats(d, s)
    hx, hy = F.col(x) > F.col("__mx"), F.col(y) > F.col("__my")
    pct = lambda c: F.round(100 * F.count_if(c) / F.count(F.lit(1)), 1)
    return d.agg(F.round(F.first("__r"), 2).alias("r"), pct(hx & hy).alias("high_high"), pct(~hx & hy).alias("low_high"), pct(hx & ~hy).alias("high_low"), pct(~hx & ~hy).alias("low_low"))
