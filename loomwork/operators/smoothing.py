"""Local regression curves and seasonal-trend decomposition, over whole tables and long series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import stored
from loomwork.functions.ordered import in_blocks, quantiles, running_before
from loomwork.operators.timeseries import hampel

#: Groups of at most this number have their few points broadcast; more are joined by a shuffle.
FEW_GROUPS = 10_000
#: Rows of a series that one task smooths, beside those around them that its windows reach.
SERIES_BLOCK = 8192
#: Fixed value: a seasonal strength above it counts as seasonality.
SEASONAL = 0.64


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its groups as ``__k0``, ``__k1``...; without groups one constant."""
    keys = [f"__k{i}" for i in range(max(len(by), 1))]
    return df.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)} if by else {"__k0": F.lit(0)}), keys


def _join_keys(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a written table with a row per group (or group and position), null keys too."""
    other = small.withColumnsRenamed({k: f"__o{k}" for k in keys})
    other = F.broadcast(other) if small.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else other
    same = F.lit(True)
    for k in keys:
        same = same & big[k].eqNullSafe(other[f"__o{k}"])
    return big.join(other, same).drop(*[f"__o{k}" for k in keys])


def local_curve(df: DataFrame, x: str, y: str, points: int = 80, span: float = 0.75, degree: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by, point, x, width, n, fit, low, high): local regressions of y on x at ``points`` even places of each group's range.

    At each place the nearest ``span`` of the group's rows weigh by the tricube of their distance over that of the
    furthest, the width; a polynomial of ``degree`` (0 to 2) is fitted to them. Widths are exact: in the order of x, the
    nearest q rows are consecutive, so the width is the least reach of all runs of q rows. Each place is then one row of weighted sums,
    added up before the shuffle. ``low`` and ``high`` are the fit's 95 % band by the local residual variance, null where
    that has no degrees of freedom. Rows with a null or NaN in x or y take no part; a group at a single x has one value, its mean.
    """
    if not 0 < span <= 1 or degree not in (0, 1, 2) or points < 2:
        raise ValueError("span must be in (0, 1], degree 0, 1 or 2, points at least 2")
    d, keys = _keyed(df.withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")}), by)
    d = stored(d.select(*keys, "__x", "__y").where("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)"))
    ends = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__x0"), F.max("__x").alias("__x1"))
    q = F.least(F.col("__n"), F.greatest(F.floor(F.lit(span) * F.col("__n") + 1e-9), F.lit(degree + 1)))
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("__x0") + (F.col("__x1") - F.col("__x0")) * i / (points - 1))
    ends = stored(ends.select(*keys, q.alias("__q"), places.alias("__g")))
    rows = running_before(d.withColumn("__one", F.lit(1).cast("long")), ["__x"], "__one", keys, "__rn")
    rows = stored(_join_keys(rows.select(*keys, "__rn", "__x"), ends, keys))
    last = rows.select(*[F.col(k).alias(f"__l{k}") for k in keys], (F.col("__rn") - F.col("__q") + 1).alias("__lrn"), F.col("__x").alias("__far"))
    same = F.col("__rn") == F.col("__lrn")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__l{k}"))
    reach = rows.join(last, same).select(*keys, "__x", "__far", F.posexplode("__g").alias("__point", "__at"))
    widths = reach.groupBy(*keys, "__point", "__at").agg(F.min(F.greatest(F.col("__at") - F.col("__x"), F.col("__far") - F.col("__at"))).alias("__h"))
    grid = stored(widths.groupBy(*keys).agg(F.collect_list(F.struct("__point", "__at", "__h")).alias("__grid")))  # a group has `points` of them
    near = _join_keys(d, grid, keys)
    near = near.withColumn("__p", F.explode(F.filter("__grid", lambda p: F.abs(F.col("__x") - p["__at"]) <= p["__h"])))
    h, away = F.col("__p.__h"), F.col("__x") - F.col("__p.__at")
    near = near.withColumn("__u", F.when(h > 0, away / h).otherwise(0.0))
    near = near.withColumn("__w", F.pow(1 - F.pow(F.abs(F.col("__u")), F.lit(3.0)), F.lit(3.0)))
    u = [F.lit(1.0), F.col("__u"), F.col("__u") * F.col("__u")]
    u += [u[2] * u[1], u[2] * u[2]]
    w, v = F.col("__w"), F.col("__y")
    sums = [F.sum(w * u[k]).alias(f"s{k}") for k in range(5)] + [F.sum(w * w * u[k]).alias(f"v{k}") for k in range(5)] + [F.sum(w * u[k] * v).alias(f"t{k}") for k in range(3)]
    moments = near.groupBy(*keys, F.col("__p.__point").alias("point"), F.col("__p.__at").alias("x"), F.col("__p.__h").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.sum(w * v * v).alias("yy"), *sums)

    def solve(batches):
        m = degree + 1
        for b in batches:
            a = np.array([[b[f"s{i + j}"] for j in range(m)] for i in range(m)], dtype=float).transpose(2, 0, 1)
            c = np.array([[b[f"v{i + j}"] for j in range(m)] for i in range(m)], dtype=float).transpose(2, 0, 1)
            t = np.array([b[f"t{i}"] for i in range(m)], dtype=float).T
            inverse = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
            beta = (inverse @ t[:, :, None])[:, :, 0]
            spread = (inverse @ c @ inverse)[:, 0, 0]
            free = b["s0"].to_numpy() - np.trace(inverse @ c, axis1=1, axis2=2)
            with np.errstate(invalid="ignore", divide="ignore"):
                half = 1.96 * np.sqrt(np.maximum(b["yy"].to_numpy() - (beta * t).sum(axis=1), 0) / free * spread)
            half = np.where(free > 1e-9, half, np.nan)
            out = b[[*keys, "point", "x", "width", "n"]].copy()
            out["fit"], out["low"], out["high"] = beta[:, 0], beta[:, 0] - half, beta[:, 0] + half
            yield out

    fields = [f"{k} {moments.schema[k].dataType.simpleString()}" for k in keys]
    fit = moments.mapInPandas(solve, ", ".join([*fields, "point int, x double, width double, n long, fit double, low double, high double"]))
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return fit.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=False)], "point", "x", "width", "n", "fit", known("low"), known("high"))


def _odd(n: float) -> int:
    n = math.ceil(n)
    return n if n % 2 else n + 1


def smooth_positions(v: np.ndarray, weights: np.ndarray, q: int, degree: int, at: np.ndarray) -> np.ndarray:
    """Local fits of degree 0 or 1 to the values at places 0, 1... by their nearest ``q``, at the places ``at``, which may lie outside.

    Where only one value weighs anything, it is the fit; where none does, all weigh as if they had the same weight.
    """
    m = len(v)
    size = min(q, m)
    out = np.empty(len(at))
    step = max(1, (1 << 20) // size)
    for a in range(0, len(at), step):
        here = at[a : a + step]
        first = np.clip(here - size // 2, 0, m - size)
        j = first[:, None] + np.arange(size)
        far = np.maximum(np.abs(here - first), np.abs(first + size - 1 - here)) * max(1.0, q / m)
        apart = (j - here[:, None]).astype(float)
        cube = (1 - np.minimum(np.abs(apart) / np.where(far > 0, far, 1.0)[:, None], 1.0) ** 3) ** 3
        w = cube * weights[j]
        w = np.where(w.sum(axis=1, keepdims=True) > 0, w, cube)  # all of them without weight: as if they had one
        w = np.where(w.sum(axis=1, keepdims=True) > 0, w, 1.0)
        w = w / w.sum(axis=1, keepdims=True)
        if degree:
            middle = (w * apart).sum(axis=1, keepdims=True)
            square = (w * (apart - middle) ** 2).sum(axis=1, keepdims=True)
            tilt = np.where(square > 1e-9, -middle / np.where(square > 1e-9, square, 1.0), 0.0)
            w = w * (1 + tilt * (apart - middle))
        out[a : a + step] = (w * v[j]).sum(axis=1)
    return out


def _seasonal(detrended: np.ndarray, weights: np.ndarray, phase: np.ndarray, period: int, window: int, low: int) -> np.ndarray:
    """Each place of the cycle smoothed by itself and carried one cycle beyond both ends, less what is slow in the whole."""
    m = len(detrended)
    cycle = np.empty(m + 2 * period)
    for p in range(period):
        own = np.flatnonzero(phase == p)
        ext = smooth_positions(detrended[own], weights[own], window, 1, np.arange(-1, len(own) + 1))
        cycle[own[0] + period * np.arange(len(ext))] = ext
    slow = cycle
    for length in (period, period, 3):
        slow = np.convolve(slow, np.full(length, 1 / length), "valid")
    return cycle[period : period + m] - smooth_positions(slow, np.ones(m), low, 1, np.arange(m))


def decompose(
    df: DataFrame, time_col: str, value_col: str, period: int, seasonal_window: int | None = None, trend_window: int | None = None, low_window: int | None = None,
    inner: int = 2, outer: int = 0, series: Sequence[str] = (), block: int = SERIES_BLOCK,
) -> DataFrame:
    """(series, time, value, seasonal, trend, remainder, weight): seasonal-trend decomposition by local regressions.

    ``seasonal_window`` None means a periodic season: means by place in the cycle, their mean taken out. Otherwise each place's
    values over the cycles are smoothed with that window (odd, at least 3), carried one cycle beyond both ends, and what moving averages of
    the cycle and a local regression find slow in them is taken out. The trend is the local regression of what the season leaves.
    ``inner`` passes, and after each of ``outer`` rounds bisquare weights by six times the exact median of absolute remainders.

    Rows are numbered in the order of time and dealt to tasks in blocks, with as many rows around them as a pass can reach; so a
    series may be of any length, and blocks change no result. Each pass is written. Rows with a null or NaN in time or value are left
    out, as are gaps: the order counts, not the distance. Equal times come in any order. A series shorter than two cycles has null parts.
    """
    if period < 2 or (seasonal_window is not None and (seasonal_window < 3 or seasonal_window % 2 == 0)) or inner < 1 or outer < 0:
        raise ValueError("period must be at least 2, the seasonal window odd and at least 3, inner at least 1")
    trend = _odd(trend_window or 1.5 * period / (1 - 1.5 / seasonal_window if seasonal_window else 1))
    low = _odd(low_window or period)
    reach = trend + 3 if seasonal_window is None else (seasonal_window + 4) * period + low + trend + 3
    block = max(block, reach)
    d, keys = _keyed(df, series)
    d = d.select(*keys, F.col(time_col).alias("__t"), F.col(value_col).cast("double").alias("__y")).where("__t is not null and __y is not null and not isnan(__y)")
    d = running_before(d.withColumn("__one", F.lit(1).cast("long")), ["__t"], "__one", keys, "__rn").drop("__one").withColumn("__rn", F.col("__rn") + 1)
    d = stored(_join_keys(d, stored(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))), keys))
    short = d.where(F.col("__n") < 2 * period)
    state = d.where(F.col("__n") >= 2 * period).withColumns({"__s": F.lit(0.0), "__trend": F.lit(0.0), "__rho": F.lit(1.0)})
    schema = state.schema

    def one_pass(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__rn", ignore_index=True)
        if not p["__own"].any():
            return p.iloc[:0][schema.names]
        y, rho = p["__y"].to_numpy(float), p["__rho"].to_numpy(float)
        if seasonal_window is not None:
            phase = ((p["__rn"] - p["__rn"].iloc[0]) % period).to_numpy()
            p["__s"] = _seasonal(y - p["__trend"].to_numpy(float), rho, phase, period, seasonal_window, low)
        p["__trend"] = smooth_positions(y - p["__s"].to_numpy(float), rho, trend, 1, np.arange(len(y)))
        return p.loc[p["__own"], schema.names]

    for round_ in range(outer + 1):
        for _ in range(inner):
            if seasonal_window is None:
                state = state.drop("__s").withColumn("__phase", F.pmod(F.col("__rn") - 1, F.lit(period)))
                free = F.col("__y") - F.col("__trend")
                weighed = F.sum(F.col("__rho") * free) / F.nullif(F.sum("__rho"), F.lit(0.0))
                means = state.groupBy(*keys, "__phase").agg(F.coalesce(weighed, F.avg(free)).alias("__c"))
                means = stored(means.withColumn("__s", F.col("__c") - F.avg("__c").over(Window.partitionBy(*keys))).drop("__c"))  # a row per place in the cycle
                state = _join_keys(state, means, [*keys, "__phase"]).select(*schema.names)
            blocks = in_blocks(state, reach, reach, block)
            state = stored(blocks.groupBy(*keys, "__block").applyInPandas(one_pass, schema))
        if round_ < outer:
            rest = F.abs(F.col("__y") - F.col("__s") - F.col("__trend"))
            middle = stored(quantiles(state.withColumn("__r", rest), ["__r"], [0.5], keys).select(*keys, (6 * F.get("q", F.lit(0))).alias("__m")))
            share = F.least(rest / F.col("__m"), F.lit(1.0))
            bisquare = (1 - share * share) * (1 - share * share)
            state = stored(_join_keys(state, middle, keys).withColumn("__rho", F.when(F.col("__m") > 0, bisquare).otherwise(1.0)).select(*schema.names))
    own = [F.col(k).alias(c) for k, c in zip(keys, series, strict=False)]
    names = [*own, F.col("__t").alias(time_col), F.col("__y").alias(value_col)]
    parts = state.select(*names, F.col("__s").alias("seasonal"), F.col("__trend").alias("trend"), (F.col("__y") - F.col("__s") - F.col("__trend")).alias("remainder"), F.col("__rho").alias("weight"))
    none = F.lit(None).cast("double")
    return parts.unionByName(short.select(*names, *[none.alias(c) for c in ("seasonal", "trend", "remainder", "weight")]))


def strengths(parts: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """(series, seasonal_strength, trend_strength, is_seasonal) of decomposed series: 1 - the remainder's variance over that of part and remainder, at least 0."""

    def strength(c: str):
        return F.greatest(F.lit(0.0), 1 - F.var_samp("remainder") / F.nullif(F.var_samp(F.col(c) + F.col("remainder")), F.lit(0.0)))

    d = parts.groupBy(*series).agg(strength("seasonal").alias("seasonal_strength"), strength("trend").alias("trend_strength"), F.count("remainder").alias("__n"))
    for c in ("seasonal_strength", "trend_strength"):
        d = d.withColumn(c, F.when(F.col("__n") > 1, F.col(c)))
    return d.drop("__n").withColumn("is_seasonal", F.coalesce(F.col("seasonal_strength") > SEASONAL, F.lit(False)))


def power_parameter(df: DataFrame, time_col: str, value_col: str, period: int, low: float = -1.0, high: float = 2.0, steps: int = 300) -> float | None:
    """The power transform's parameter that evens out the spread: over whole cycles (the first rows that fill none are left out), the
    least coefficient of variation of deviation / mean ** (1 - parameter), of ``steps`` + 1 even candidates.

    None where values aren't all positive or fewer than two cycles are there.
    """
    d = df.select(F.col(time_col).alias("__t"), F.col(value_col).cast("double").alias("__y")).where("__t is not null and __y is not null and not isnan(__y)")
    d = stored(running_before(d.withColumn("__one", F.lit(1).cast("long")), ["__t"], "__one", out="__rn"))
    n, least = d.agg(F.count(F.lit(1)), F.min("__y")).first()
    if n < 2 * period or least <= 0:
        return None
    cycles = d.where(F.col("__rn") >= n % period).groupBy(F.floor((F.col("__rn") - n % period) / period)).agg(F.avg("__y").alias("m"), F.stddev_samp("__y").alias("s"))
    cycles = cycles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("p", low + (high - low) * F.col("i") / steps)
    ratio = F.col("s") / F.pow(F.col("m"), 1 - F.col("p"))
    found = cycles.groupBy("p").agg((F.stddev_samp(ratio) / F.nullif(F.avg(ratio), F.lit(0.0))).alias("cv")).where("cv is not null").orderBy("cv", "p").first()
    return found["p"] if found else 1.0


def detect_seasonality(
    df: DataFrame, time_col: str, value_col: str, period: int, transformation: str = "boxcox", parameter: float | None = None, outlier_window: int | None = 3,
    seasonal_window: int | None = None, outer: int = 0,
) -> tuple[bool, DataFrame]:
    """(seasonal or not, parts): the values transformed, spikes repaired, decomposed, and held against the strength that counts as seasonal.

    ``transformation`` is boxcox (``parameter`` by ``power_parameter`` where not given; values that aren't all positive stay as they
    are), log or none; ``outlier_window`` None leaves spikes. Rows without a value are left out, and logarithms of what has none.
    """
    y = F.col(value_col).cast("double")
    if transformation == "boxcox":
        parameter = power_parameter(df, time_col, value_col, period) if parameter is None else parameter
        y = y if parameter is None else F.log(y) if abs(parameter) < 1e-9 else (F.pow(y, F.lit(float(parameter))) - 1) / parameter
    elif transformation == "log":
        y = F.log(y)
    elif transformation != "none":
        raise ValueError(f"no such transformation: {transformation}")
    d = df.select(time_col, y.alias(value_col)).where(F.col(value_col).isNotNull() & ~F.isnan(value_col))
    if outlier_window is not None:
        d = hampel(d, time_col, value_col, outlier_window).select(time_col, F.col("repaired").alias(value_col))
    parts = decompose(d, time_col, value_col, period, seasonal_window, outer=outer)
    return strengths(parts).first()["is_seasonal"], parts
