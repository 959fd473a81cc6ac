"""Descriptive statistics of columns, by type and by group, and readability of texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.core import numeric_columns, require_columns
from loomwork.functions.ordered import FEW_VALUES, average_ranks, quantile_values, quantiles


def modes(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """All most frequent values of a column, sorted and joined by ``, `` (``mode``), with ``n_modes`` and ``freq``; nulls don't count."""
    require_columns(df, [column, *by])
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).count()
    grouped = counts.groupBy(*by, "count").agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ", ").alias("mode"), F.count(F.lit(1)).alias("n_modes"))
    top = Window.partitionBy(*by).orderBy(F.desc("count"))
    return grouped.withColumn("__r", F.row_number().over(top)).where("__r = 1").select(*by, "mode", "n_modes", F.col("count").alias("freq"))


def numeric_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row per column (and group): mean, median, deviations, moments, sums, range, quartiles, scaled median deviation.

    Kurtosis is the raw fourth standardised moment; quartiles interpolate linearly. Moments are one aggregate;
    order statistics are exact, see ``quantiles``, once for the values and once for their distances from the median.
    """
    require_columns(df, [*columns, *by])
    d = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    rows = []
    for c in columns:
        x = F.col(c)
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sample_sd"), F.stddev_pop(x).alias("pop_sd"), (F.kurtosis(x) + 3).alias("kurtosis"), F.skewness(x).alias("skewness"),
            F.sum(x).alias("sum"), F.sum(F.abs(x)).alias("abs_sum"), F.min(x).alias("min"), F.max(x).alias("max"),
        ))
    moments = d.groupBy(*by).agg(F.array(*rows).alias("__rows")).select(*by, F.inline("__rows"))
    if by:
        q = quantiles(d, columns, (0.25, 0.5, 0.75), by)
        middle = F.get("q", F.lit(1))
        names = [f"__g{i}" for i in range(len(by))]
        centre = q.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(*[F.max(F.when(F.col("variable") == c, middle)).alias(f"__m{i}") for i, c in enumerate(columns)])
        near = d.join(centre, _same_keys(d, by, centre, names)).drop(*names)
        mad = quantiles(near, {c: F.abs(F.col(c) - F.col(f"__m{i}")) for i, c in enumerate(columns)}, (0.5,), by)
        keys = [*by, "variable"]
        order = q.select(*[F.col(c).alias(f"__q{i}") for i, c in enumerate(keys)], middle.alias("median"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(2)).alias("q3"))
        spread = mad.select(*[F.col(c).alias(f"__d{i}") for i, c in enumerate(keys)], (1.4826 * F.get("q", F.lit(0))).alias("mad"))
        out = moments.join(order, _same_keys(moments, keys, order, [f"__q{i}" for i in range(len(keys))]))
        out = out.join(spread, _same_keys(out, keys, spread, [f"__d{i}" for i in range(len(keys))]))
    else:  # a row per column: put together here
        found = {r["variable"]: r for r in moments.collect()}
        few = [c for c, n in zip(columns, d.agg(*[F.approx_count_distinct(c) for c in columns]).first(), strict=True) if n <= FEW_VALUES]
        q = quantile_values(d, columns, (0.25, 0.5, 0.75), few)
        known = [c for c in columns if q[c][1] is not None]
        away = quantile_values(d, {c: F.abs(F.col(c) - F.lit(q[c][1])) for c in known}, (0.5,), few) if known else {}
        figures = [(*[found[c][f] for f in moments.columns], q[c][1], q[c][0], q[c][2], 1.4826 * away[c][0] if c in away else None) for c in columns]
        schema = T.StructType([*moments.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("median", "q1", "q3", "mad")]])
        keys, out = ["variable"], df.sparkSession.createDataFrame(figures, schema)
    return out.select(*keys, "mean", "median", "sample_sd", "pop_sd", "kurtosis", "skewness", "sum", "abs_sum", "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "mad")


def _same_keys(a: DataFrame, left: Sequence[str], b: DataFrame, right: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(left, right, strict=True):
        out = out & a[x].eqNullSafe(b[y])
    return out


def column_overview(df: DataFrame) -> DataFrame:
    """A row per column: nulls, share that isn't null, distinct values (null counts as one), extremes as text, text lengths.

    One aggregate over all columns, then reshaped.
    """
    kinds = dict(df.dtypes)
    numeric = set(numeric_columns(df))
    aggs, rows = [], []
    for i, c in enumerate(df.columns):
        k = F.col(c)
        text = kinds[c] == "string"
        aggs += [
            F.count_if(k.isNull()).alias(f"nulls{i}"), F.count(F.lit(1)).alias(f"n{i}"), F.count_distinct(k).alias(f"d{i}"),
            (F.max(k) if c in numeric or text else F.lit(None)).cast("string").alias(f"max{i}"), (F.min(k) if c in numeric or text else F.lit(None)).cast("string").alias(f"min{i}"),
            (F.avg(F.length(k)) if text else F.lit(None).cast("double")).alias(f"avg{i}"), (F.max(F.length(k)) if text else F.lit(None).cast("int")).alias(f"len{i}"), (F.min(F.length(k)) if text else F.lit(None).cast("int")).alias(f"short{i}"),
        ]
        col = lambda p, i=i: F.col(f"{p}{i}")
        rows.append(F.struct(
            F.lit(c).alias("variable"), col("nulls").alias("nulls"), F.round(100 * (col("n") - col("nulls")) / col("n"), 2).alias("pct_non_null"), (col("d") + (col("nulls") > 0).cast("int")).alias("unique_levels"),
            col("max").alias("max"), col("min").alias("min"), col("avg").alias("avg_chars"), col("len").alias("max_chars"), col("short").alias("min_chars"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def factor_stats(df: DataFrame, column: str) -> DataFrame:
    """A row per level: count and percentage (2 digits), null a level of its own."""
    counts = df.groupBy(column).count()
    return counts.select(F.col(column).alias("level"), F.col("count").alias("n"), F.round(100 * F.col("count") / F.sum("count").over(Window.partitionBy()), 2).alias("pct"))


def date_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: invalid dates, first, last, middle, span, gaps between distinct dates, longest and shortest runs of consecutive days.

    The order is over distinct days, however many rows there are; runs need at least two days.
    """
    day = F.try_to_date(F.col(column).cast("string").substr(1, 10))
    days = df.select(day.alias("d")).where("d is not null").distinct()
    order = Window.orderBy("d")
    gaps = days.withColumn("gap", F.datediff("d", F.lag("d").over(order)))
    gaps = gaps.withColumn("island", F.sum(F.when(F.coalesce("gap", F.lit(0)) == 1, 0).otherwise(1)).over(order))
    runs = gaps.groupBy("island").agg(F.count(F.lit(1)).alias("days")).where("days > 1").agg(F.max("days").alias("longest_streak"), F.min("days").alias("shortest_streak"))
    s = gaps.agg(F.min("d").alias("first"), F.max("d").alias("last"), F.avg("gap").alias("avg_gap"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"), F.min("gap").alias("min_gap"))
    s = s.withColumn("span", F.datediff("last", "first")).withColumn("middle", F.expr("date_add(first, cast(floor(span / 2) as int))"))
    bad = df.agg(F.count_if(day.isNull()).alias("invalid"))
    return s.crossJoin(runs).crossJoin(bad)  # one row each


KINDS = ("numeric", "factor", "date", "character", "other")


def column_kinds(df: DataFrame, given: Mapping[str, str] | None = None) -> dict[str, str]:
    """numeric, date, character or other by type; ``given`` overrides it by name and may say factor (or skip)."""
    numeric, out = set(numeric_columns(df)), {}
    for c, t in df.dtypes:
        out[c] = "numeric" if c in numeric else "date" if t.startswith(("date", "timestamp")) else "character" if t == "string" else "other"
    for c, k in (given or {}).items():
        if k not in (*KINDS, "skip"):
            raise ValueError(f"no such kind: {k}")
        if c in out:
            out[c] = k
    return out


def character_stats(df: DataFrame, columns: Sequence[str], lengths: bool = True) -> DataFrame:
    """(variable, nulls, unique, avg_length, max_length, min_length) per column, null a value of its own; one aggregate."""
    rows = []
    for c in columns:
        x, size = F.col(c), F.length(F.col(c).cast("string")) if lengths else F.lit(None).cast("int")
        unique = F.count_distinct(x) + F.max(x.isNull().cast("int"))
        rows.append(F.struct(F.lit(c).alias("variable"), F.count_if(x.isNull()).alias("nulls"), unique.alias("unique"), F.avg(size).alias("avg_length"), F.max(size).alias("max_length"), F.min(size).alias("min_length")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def all_stats(frames: DataFrame | Mapping[str, DataFrame], given: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, dict[str, DataFrame | None]]:
    """For each table and kind of column the statistics of that kind, None where it has no such column.

    Columns that ``given`` calls numeric or date are read as such first (what doesn't parse is unknown); numeric
    columns that don't parse at all are skipped. A single table is named ``data``.
    """
    named, out = {"data": frames} if isinstance(frames, DataFrame) else dict(frames), {}
    for name, df in named.items():
        wish = (given or {}).get(name, {})
        kinds = column_kinds(df, wish)
        numeric = set(numeric_columns(df))
        asked = [c for c, k in kinds.items() if k == "numeric" and c not in numeric]
        df = df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in asked}) if asked else df
        if asked:
            known = df.agg(*[F.count(c).alias(c) for c in asked]).first()
            kinds |= {c: "skip" for c in asked if not known[c]}
        of = {k: [c for c in df.columns if kinds[c] == k] for k in KINDS}
        levels = [factor_stats(df, c).select(F.lit(c).alias("variable"), F.col("level").cast("string").alias("level"), "n", "pct") for c in of["factor"]]
        days = [date_stats(df, c).select(F.lit(c).alias("variable"), "*") for c in of["date"]]
        out[name] = {
            "numeric": numeric_stats(df, of["numeric"]) if of["numeric"] else None, "factor": reduce(DataFrame.unionByName, levels) if levels else None, "date": reduce(DataFrame.unionByName, days) if days else None,
            "character": character_stats(df, of["character"]) if of["character"] else None, "other": character_stats(df, of["other"], False).select("variable", "nulls", "unique") if of["other"] else None,
        }
    return out


def group_stats(df: DataFrame, by: Sequence[str]) -> dict[str, DataFrame | None]:
    """Statistics by group for each kind of column: numeric figures, counts and shares of text values within their group, first and last days."""
    kinds = column_kinds(df.drop(*by))
    of = {k: [c for c, x in kinds.items() if x == k] for k in KINDS}
    shares = None
    if of["character"]:
        long = df.select(*by, *of["character"]).unpivot(list(by), of["character"], "variable", "level")
        counts = long.groupBy(*by, "variable", "level").agg(F.count(F.lit(1)).alias("n"))
        shares = counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by, "variable")), 2))
    days = None
    if of["date"]:
        rows = [F.struct(F.lit(c).alias("variable"), F.min(F.to_date(c)).alias("first"), F.max(F.to_date(c)).alias("last"), F.count_distinct(F.to_date(c)).alias("days")) for c in of["date"]]
        days = df.groupBy(*by).agg(F.array(*rows).alias("__r")).select(*by, F.inline("__r"))
    return {"numeric": numeric_stats(df, of["numeric"], by) if of["numeric"] else None, "character": shares, "date": days}


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson's r of each pair of columns (and group), over rows where both are known, from one aggregate."""
    require_columns(df, [*columns, *by])
    pairs = list(combinations(columns, 2))
    d = df.groupBy(*by).agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return d.select(*by, F.inline(F.array(*rows)))


def rank_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman's r of each pair of columns: Pearson's of average ranks, ranked among all rows with the column known."""
    d = df
    for i, c in enumerate(columns):
        ranks = average_ranks(df, c).select(F.col("x").alias(f"__v{i}"), F.col("rank").alias(f"__rank_{c}"))  # a row per distinct value
        d = d.join(ranks, d[c] == ranks[f"__v{i}"], "left").drop(f"__v{i}")
    out = correlations(d, [f"__rank_{c}" for c in columns])
    return out.select(F.expr("substring(var1, 8)").alias("var1"), F.expr("substring(var2, 8)").alias("var2"), "r")


def compare_correlations(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """The absolute difference of each pair's correlation between each two groups."""
    r = correlations(df, columns, [group])
    a, b = r.withColumnsRenamed({group: "group1", "r": "r1"}), r.withColumnsRenamed({group: "group2", "r": "r2"})
    return a.join(b, ["var1", "var2"]).where("group1 < group2").withColumn("abs_diff", F.abs(F.col("r1") - F.col("r2"))).select("group1", "group2", "var1", "var2", "abs_diff")


def histogram(df: DataFrame, column: str, width: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts by bin, centred on multiples of the width; the default width is a thirtieth of the range, 1 where that is empty or a point."""
    if width is None:
        lo, hi = df.agg(F.min(column), F.max(column)).first()
        width = 1.0 if lo is None else float(hi - lo) / 30 or 1.0
    bin_ = F.floor(F.col(column).cast("double") / width + 0.5) * width
    return df.where(F.col(column).isNotNull()).groupBy(*by, bin_.alias("bin")).count()


def readability(df: DataFrame, text_col: str) -> DataFrame:
    """Words, sentences, complex words, characters, and four indices of each text; a text has at least two sentences by the rule kept here."""
    words = F.split(F.col(text_col), "[^A-Za-z0-9_]+")
    words = F.when(F.element_at(words, -1) == "", F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    d = df.withColumn("__w", words).withColumn("words", F.size("__w"))
    d = d.withColumn("sentences", F.greatest(F.regexp_count(text_col, F.lit(r"[.!?][ \t\n]+[A-Z]")), F.lit(1)) + 1)
    d = d.withColumn("complex_words", F.size(F.filter("__w", lambda w: (F.length(w) > 2) & (F.length(F.regexp_replace(w, "[aeiou]", "")) > 1))))
    d = d.withColumn("chars", F.length(F.regexp_replace(text_col, r"[ \t\n\r]", "")))
    d = d.withColumn("gunning_fog", 0.4 * (F.col("words") / F.col("sentences") + 100 * F.col("complex_words") / F.col("words")))
    d = d.withColumn("coleman_liau", 0.0588 * (100 * F.col("chars") / F.col("words")) - 0.296 * (100 * F.col("sentences") / F.col("words")) - 15.8)
    d = d.withColumn("smog", F.sqrt(30 * F.col("complex_words") / F.col("sentences")) + 3)
    return d.withColumn("lexical_diversity", F.size(F.array_distinct("__w")) / F.col("words")).drop("__w")


def shape_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column scaled, exponentiated and described: sum, mean, sd, skewness, kurtosis."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "x")
    s = long.groupBy("variable").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    e: Column = F.exp((F.col("x") - F.col("m")) / F.col("s"))
    z = long.join(F.broadcast(s), "variable").select("variable", e.alias("e"))
    return z.groupBy("variable").agg(F.sum("e").alias("sum"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.skewness("e").alias("skewness"), (F.kurtosis("e") + 3).alias("kurtosis"))


def web_mercator(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """``x`` and ``y`` in metres on the spherical Mercator map."""
    r = 6378137.0
    return df.withColumn("x", F.radians(lon) * r).withColumn("y", F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * r)
