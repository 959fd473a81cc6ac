"""Series: calendar buckets with rolling lines, trends, adstock, exponential smoothing, spike repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored
from loomwork.functions.ordered import in_blocks, numbered, quantiles, running_before

UNITS = ("day", "week", "month", "quarter", "year")
#: Exponential smoothing: rows of a series that one task works on, and how far back the start of a block lies (0.99 ** 8192 is under 1e-35).
SMOOTHED_ROWS = 1 << 16
MEMORY = 1 << 13


def bucketed_series(df: DataFrame, date_col: str, value_col: str, unit: str = "day", window: int = 7, bar: str = "sum", line: str = "mean") -> DataFrame:
    """A row per calendar bucket present: ``bar`` over its values, and ``line`` over the last ``window`` buckets' bars.

    Weeks start on Monday. The first ``window`` - 1 lines are null. Gaps aren't filled.
    """
    require_columns(df, [date_col, value_col])
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    bars = {"sum": F.sum, "mean": F.avg, "median": None}[bar]
    lines = {"mean": F.avg, "max": F.max, "min": F.min, "median": lambda c: F.percentile(c, F.lit(0.5))}[line]
    day = F.to_date(date_col)
    bucket = day if unit == "day" else F.trunc(date_col, unit).cast("date")
    known = df.where(F.col(date_col).isNotNull()).withColumn("bucket", bucket)
    if bar == "median":
        out = quantiles(known, [value_col], (0.5,), ["bucket"]).select("bucket", F.get("q", F.lit(0)).alias("bar"))
    else:
        out = known.groupBy("bucket").agg(bars(value_col).alias("bar"))
    order = Window.orderBy("bucket")  # over buckets, not rows
    return out.withColumn("line", F.when(F.row_number().over(order) >= window, lines("bar").over(order.rowsBetween(1 - window, 0))))


def period_means(df: DataFrame, year_col: str, value_col: str, periods: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Mean values by spans of years that start at multiples of each period."""
    spans = F.explode(F.array(*[F.lit(p) for p in periods]))
    d = df.select(F.col(year_col).alias("y"), F.col(value_col).alias("v"), spans.alias("period"))
    return d.groupBy("period", (F.col("y") - F.col("y") % F.col("period")).alias("start_year")).agg(F.avg("v").alias("mean"))


def adstock_weights(lag: int, decay: float) -> list[float]:
    """decay^i for i below ``lag``, scaled to sum 1."""
    if lag < 1 or int(lag) != lag:
        raise ValueError("lag must be a positive integer")
    if not 0 <= decay <= 1:
        raise ValueError("decay must lie between 0 and 1")
    w = [decay**i for i in range(int(lag))]
    return [x / sum(w) for x in w]


def _adstock(value: str, lag: int, decay: float, order, position: Column, pad: bool) -> Column:
    w = adstock_weights(lag, decay)
    total = sum((F.coalesce(F.lag(value, lag - 1 - i).over(order), F.lit(0.0)) * w[i] for i in range(1, lag)), F.coalesce(F.lag(value, lag - 1).over(order), F.lit(0.0)) * w[0])
    return total if pad else F.when(position >= lag, total)


def adstock(df: DataFrame, time_col: str, value_col: str, lag: int, decay: float, series: Sequence[str] = (), pad: bool = False) -> DataFrame:
    """``adstock``: the weighted sum of the last ``lag`` values, the largest weight on the oldest.

    The first ``lag`` - 1 rows of a series are null, or are summed as if zeros came before them (``pad``).
    One long series is worked on in blocks of its order, each with the rows before it that it needs.
    """
    if series:
        order = Window.partitionBy(*series).orderBy(time_col)
        return df.withColumn("adstock", _adstock(value_col, lag, decay, order, F.row_number().over(order), pad))
    d = in_blocks(numbered(df, [time_col]), back=lag - 1)
    order = Window.partitionBy("__block").orderBy("__rn")
    return d.withColumn("adstock", _adstock(value_col, lag, decay, order, F.col("__rn"), pad)).where("__own").drop("__rn", "__block", "__own")


def trend_forecast_error(df: DataFrame, time_col: str, value_col: str, lag: int, decay: float, folds: int = 10) -> DataFrame:
    """Mean over contiguous folds of the squared error of a linear trend, fitted to the adstock of the rows outside the fold.

    Each fold is cut out of the series first; the rest is numbered on without it and its adstock taken
    anew, as if zeros came before it, so nothing of the fold reaches the rows behind it. The fold is forecast after
    the rest. Rows beyond folds x (n // folds) are in no fold and train in all. Fewer rows than folds give null.
    """
    d = stored(numbered(df.select(time_col, F.col(value_col).cast("double").alias("x")), [time_col]))
    n = d.count()
    size = n // folds
    if not size:
        return d.agg(F.lit(None).cast("double").alias("error"))
    k = d.sparkSession.range(folds).select(F.col("id").cast("int").alias("k"))  # a few folds
    fold = F.floor((F.col("__rn") - 1) / size).cast("int")
    train = d.withColumn("fold", fold).crossJoin(F.broadcast(k)).where("fold != k").withColumn("t", F.when(F.col("fold") > F.col("k"), F.col("__rn") - size).otherwise(F.col("__rn")))
    blocks = in_blocks(train, back=lag - 1, number="t")
    order = Window.partitionBy("k", "__block").orderBy("t")
    train = blocks.withColumn("adstock", _adstock("x", lag, decay, order, F.col("t"), True)).where("__own")
    line = train.groupBy("k").agg(F.regr_slope("adstock", "t").alias("b"), F.regr_intercept("adstock", "t").alias("a"))
    test = d.withColumn("fold", fold).where(F.col("fold") < folds).join(F.broadcast(line), F.col("fold") == F.col("k"))
    error = F.col("x") - (F.col("a") + F.col("b") * (n - size + F.col("__rn") - F.col("fold") * size))
    return test.groupBy("fold").agg(F.sum(error * error).alias("sse")).agg(F.avg("sse").alias("error"))


def walk_forward_error(df: DataFrame, time_col: str, value_col: str, lag: int, decay: float, step: int = 1) -> DataFrame:
    """From the middle of the series on, in whole steps: the mean absolute difference of values and adstock, averaged over steps."""
    d = in_blocks(numbered(df, [time_col]), back=lag - 1)
    n = df.count()
    start = round(n * 0.5)
    d = d.withColumn("adstock", _adstock(value_col, lag, decay, Window.partitionBy("__block").orderBy("__rn"), F.col("__rn"), True)).where("__own")
    last = start + (n - start) // step * step
    steps = d.where((F.col("__rn") > start) & (F.col("__rn") <= last)).groupBy(F.floor((F.col("__rn") - start - 1) / step).alias("s")).agg(F.avg(F.abs(F.col(value_col) - F.col("adstock"))).alias("mae"))
    return steps.agg(F.avg("mae").alias("error"))


def grid_search(df: DataFrame, time_col: str, value_col: str, lags: Sequence[int], decays: Sequence[float], method: str = "folds", folds: int = 10, step: int = 1) -> DataFrame:
    """(lag, decay, error, best) for each pair: the error of ``trend_forecast_error`` (folds) or ``walk_forward_error`` (walk).

    All pairs are computed in one job over the series, numbered once; the least error is best, of equal ones
    the least lag, then decay.
    """
    if method not in ("folds", "walk"):
        raise ValueError(f"no such method: {method}")
    d = stored(numbered(df.select(time_col, F.col(value_col).cast("double").alias("x")), [time_col]))
    n = d.count()
    size, start = n // folds, round(n * 0.5)
    grid = [(lag, float(decay)) for lag in lags for decay in decays]
    longest = max(lags)
    if method == "folds":
        k = d.sparkSession.range(folds).select(F.col("id").cast("int").alias("k"))  # a few folds
        fold = F.floor((F.col("__rn") - 1) / max(size, 1)).cast("int")
        t = d.withColumn("fold", fold).crossJoin(F.broadcast(k)).where("fold != k").withColumn("t", F.when(F.col("fold") > F.col("k"), F.col("__rn") - size).otherwise(F.col("__rn")))
    else:
        t = d.withColumn("k", F.lit(0)).withColumn("t", F.col("__rn"))
    blocks = in_blocks(t, back=longest - 1, number="t")
    order = Window.partitionBy("k", "__block").orderBy("t")
    both = [F.struct(F.lit(lag).alias("lag"), F.lit(decay).alias("decay"), _adstock("x", lag, decay, order, F.col("t"), True).alias("adstock")) for lag, decay in grid]
    long = blocks.withColumn("__all", F.array(*both)).where("__own").select("k", "t", "x", F.inline("__all"))
    if method == "folds":
        line = long.groupBy("lag", "decay", "k").agg(F.regr_slope("adstock", "t").alias("b"), F.regr_intercept("adstock", "t").alias("a"))
        test = d.withColumn("fold", fold).where(F.col("fold") < folds).join(F.broadcast(line), F.col("fold") == F.col("k"))  # a line per pair and fold
        error = F.col("x") - (F.col("a") + F.col("b") * (n - size + F.col("__rn") - F.col("fold") * size))
        found = test.groupBy("lag", "decay", "fold").agg(F.sum(error * error).alias("e"))
    else:
        last = start + (n - start) // step * step
        found = long.where((F.col("t") > start) & (F.col("t") <= last)).groupBy("lag", "decay", F.floor((F.col("t") - start - 1) / step).alias("s")).agg(F.avg(F.abs(F.col("x") - F.col("adstock"))).alias("e"))
    out = found.groupBy("lag", "decay").agg(F.avg("e").alias("error"))
    return out.withColumn("best", F.row_number().over(Window.orderBy("error", "lag", "decay")) == 1)  # a row per pair


def brown_smoothing(df: DataFrame, time_col: str, value_col: str, alphas: Sequence[float], k: int = 5, ahead: int = 1, series: Sequence[str] = (), block: int = SMOOTHED_ROWS) -> DataFrame:
    """Double exponential smoothing for each alpha (from 0.01 to 0.99): series, alpha, sse, rmse, level and trend at the end, best.

    The first ``k`` values' trend line starts both averages; from the second value on each is smoothed.
    Errors are of forecasts ``ahead`` steps on, from step ``k`` to the end. A series may be of any length: rows are numbered and dealt to
    tasks in blocks. What lies more than ``MEMORY`` rows back weighs less than 1e-31, so a block starts that far before its own rows and a task
    holds a block and no more. Rows without a time or value are left out, and series of no more than ``k + ahead`` rows.
    """
    if k < 2 or ahead < 1:
        raise ValueError("k must be at least 2, ahead at least 1")
    alphas = [min(0.99, max(0.01, a)) for a in alphas]
    d = df.select(*series, F.col(time_col).alias("__t"), F.col(value_col).cast("double").alias("__v")).where("__t is not null and __v is not null")
    d = running_before(d.withColumn("__one", F.lit(1).cast("long")), ["__t"], "__one", series, "__rn").withColumn("__rn", F.col("__rn") + 1)
    block = max(block, MEMORY, k + ahead)
    d = in_blocks(d, MEMORY, ahead, block).groupBy(*series, "__block").agg(F.array_sort(F.collect_list(F.struct("__rn", "__v"))).alias("__rows"), F.max("__own").alias("__any"))
    d = d.where("__any").select(*series, "__block", F.transform("__rows", lambda r: r["__v"]).alias("x"), (F.col("__rows")[0]["__rn"] - 1).cast("int").alias("__skip"))
    d = d.where((F.col("__block") > 0) | (F.size("x") > k + ahead)).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    head, i = F.slice("x", 1, k), F.transform(F.sequence(F.lit(1), F.lit(k)), lambda t: t.cast("double"))
    mean = F.aggregate(head, F.lit(0.0), lambda s, v: s + v) / k
    slope = F.aggregate(F.zip_with(head, i, lambda v, t: v * (t - (k + 1) / 2)), F.lit(0.0), lambda s, v: s + v) / (k * (k * k - 1) / 12)
    d = d.withColumn("b", slope).withColumn("a", mean - slope * (k + 1) / 2)
    q, far = (1 - F.col("alpha")) / F.col("alpha"), F.col("__block") > 0
    s1, s2 = (F.when(far, F.get("x", F.lit(0))).otherwise(F.col("a") - times * q * F.col("b")) for times in (1, 2))
    start = F.struct(s1.alias("s1"), s2.alias("s2"), F.lit(0.0).alias("sse"), F.lit(0).alias("n"))

    def step(s: Column, t: Column) -> Column:
        v = F.element_at("x", t)
        s1 = F.col("alpha") * v + (1 - F.col("alpha")) * s["s1"]
        s2 = F.col("alpha") * s1 + (1 - F.col("alpha")) * s["s2"]
        forecast = 2 * s1 - s2 + F.col("alpha") / (1 - F.col("alpha")) * (s1 - s2) * ahead
        at = t + F.col("__skip")  # its number in the series
        counts = (at >= k) & (t <= F.size("x") - ahead) & (F.floor((at - 1) / block) == F.col("__block"))
        e = F.get("x", t + ahead - 1) - forecast
        return F.struct(s1.alias("s1"), s2.alias("s2"), F.when(counts, s["sse"] + e * e).otherwise(s["sse"]).alias("sse"), (s["n"] + counts.cast("int")).alias("n"))

    d = d.withColumn("end", F.aggregate(F.sequence(F.lit(2), F.size("x")), start, step))
    level, trend = 2 * F.col("end.s1") - F.col("end.s2"), F.col("alpha") / (1 - F.col("alpha")) * (F.col("end.s1") - F.col("end.s2"))
    rows = d.groupBy(*series, "alpha").agg(F.sum("end.sse").alias("sse"), F.sqrt(F.sum("end.sse") / F.sum("end.n")).alias("rmse"), F.max_by(level, "__block").alias("level"), F.max_by(trend, "__block").alias("trend"))
    best = Window.partitionBy(*series).orderBy("sse", "alpha")
    return rows.withColumn("best", F.row_number().over(best) == 1)


def hampel(df: DataFrame, time_col: str, value_col: str, k: int = 3, limit: float = 3.0, series: Sequence[str] = ()) -> DataFrame:
    """``repaired``: values further than ``limit`` scaled median deviations from the median of the 2k + 1 around them become that median."""
    if series:
        d, around = df, Window.partitionBy(*series).orderBy(time_col).rowsBetween(-k, k)
    else:  # one long series, in blocks with the rows around them
        d, around = in_blocks(numbered(df, [time_col]), back=k, ahead=k), Window.partitionBy("__block").orderBy("__rn").rowsBetween(-k, k)
    d = d.withColumn("__near", F.collect_list(F.col(value_col).cast("double")).over(around))
    middle = lambda a: (F.element_at(F.array_sort(a), (F.floor((F.size(a) + 1) / 2)).cast("int")) + F.element_at(F.array_sort(a), (F.floor(F.size(a) / 2) + 1).cast("int"))) / 2
    d = d if series else d.where("__own").drop("__rn", "__block", "__own")
    d = d.withColumn("__med", middle(F.col("__near")))
    d = d.withColumn("__dev", F.transform("__near", lambda v: F.abs(v - F.col("__med"))))
    spike = F.abs(F.col(value_col) - F.col("__med")) > limit * 1.4826 * middle(F.col("__dev"))
    return d.withColumn("repaired", F.when(spike, F.col("__med")).otherwise(F.col(value_col).cast("double"))).drop("__near", "__med", "__dev")


def calendar_grid(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """The 31 x 12 grid of day and month with the summed value; days without values, and no days, are null."""
    sums = df.groupBy(F.dayofmonth(date_col).alias("day"), F.month(date_col).alias("month")).agg(F.sum(value_col).alias("value"))
    days, months = (df.sparkSession.range(1, n).select(F.col("id").cast("int").alias(c)) for n, c in ((32, "day"), (13, "month")))
    return days.crossJoin(months).join(F.broadcast(sums), ["day", "month"], "left")  # 372 rows
