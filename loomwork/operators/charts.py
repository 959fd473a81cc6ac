"""The tables behind charts: what each chart aggregates, without its drawing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.ordered import quantile_values, quantiles

STATISTICS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}


def survey_frequencies(df: DataFrame, items: Sequence[str], labels: Sequence[str], regroup: Mapping[str, str] | None = None, by: str | None = None) -> DataFrame:
    """Per item (and group): answers 1..k by label, optionally merged, with count and percentage; other answers are left out."""
    keys = [by] if by else []
    long = df.unpivot(keys, list(items), "item", "answer") if keys else df.select(*items).unpivot([], list(items), "item", "answer")
    names = F.create_map(*[F.lit(x) for i, n in enumerate(labels, 1) for x in (i, (regroup or {}).get(n, n))])
    long = long.withColumn("response", F.try_element_at(names, F.col("answer").cast("int"))).where("response is not null")
    counts = long.groupBy("item", *keys, "response").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("item", *keys)))


def stacked_percentages(df: DataFrame, group: str, value: str) -> DataFrame:
    """n and percentage of each value within its group."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def level_percentages(df: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    """Count and percentage of each level; with ``nulls`` unknown values are one more, ``NA's``."""
    d = df.select(F.coalesce(F.col(column).cast("string"), F.lit("NA's")).alias("level")) if nulls else df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("level"))
    counts = d.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def _threshold(df: DataFrame, y: str, threshold: float | str) -> Column:
    if threshold == "median":
        value = quantile_values(df, [y], (0.5,))[y][0]
    else:
        value = df.agg(F.avg(y)).first()[0] if threshold == "mean" else float(threshold)
    return F.lit(value).cast("double")


def benchmarked(df: DataFrame, x: str, y: str, threshold: float | str = "mean") -> DataFrame:
    """Per x: mean, rows, sd, standard error, and whether the mean reaches the threshold of all the data."""
    g = df.groupBy(x).agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("sd"))
    g = g.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("threshold", _threshold(df, y, threshold))
    return g.withColumn("reached", F.col("mean") >= F.col("threshold"))


def centred(df: DataFrame, x: str, y: str, threshold: float | str = "mean") -> DataFrame:
    """Per x: the shares of rows at or above, and below, the threshold; unknown values count in the rows."""
    t = _threshold(df, y, threshold)
    return df.groupBy(x).agg((F.count_if(F.col(y) >= t) / F.count(F.lit(1))).alias("above"), (F.count_if(F.col(y) < t) / F.count(F.lit(1))).alias("below"))


def diverging(df: DataFrame, left: str, right: str, category: str) -> DataFrame:
    """Long (category, side, value) with the left side negated."""
    return df.select(category, (-F.col(left)).alias("left"), F.col(right).alias("right")).unpivot([category], ["left", "right"], "side", "value")


def profile(df: DataFrame, columns: Sequence[str], stat: str = "mean", error: str = "sd", width: float = 2.0) -> DataFrame:
    """Per column: the statistic and the ends of its bar, ``width`` times the sd, standard error or half the quartile range."""
    if stat not in STATISTICS or error not in ("sd", "sem", "iqr"):
        raise ValueError(f"no such statistic: {stat}, {error}")
    ordered = stat == "median" or error == "iqr"
    q = {c: F.array(*[F.lit(v).cast("double") for v in x]) for c, x in quantile_values(df, columns, (0.25, 0.5, 0.75)).items()} if ordered else {}
    rows = []
    for c in columns:
        x = F.col(c).cast("double")
        e = F.get(q[c], F.lit(2)) - F.get(q[c], F.lit(0)) if error == "iqr" else None
        bar = {"sd": F.stddev_samp(x), "sem": F.stddev_samp(x) / F.sqrt(F.count(x)), "iqr": e / 2 if e is not None else None}[error]
        rows.append(F.struct(F.lit(c).alias("variable"), (F.get(q[c], F.lit(1)) if stat == "median" else STATISTICS[stat](x).cast("double")).alias("value"), (bar * width).alias("e")))
    g = df.agg(F.array(*rows).alias("__rows")).select(F.inline("__rows"))
    return g.select("variable", "value", (F.col("value") - F.col("e")).alias("low"), (F.col("value") + F.col("e")).alias("high"))


def by_group(df: DataFrame, x: str, y: str, stat: str = "mean", threshold: float | None = None) -> DataFrame:
    """The statistic of y per x, and whether it reaches the threshold; an unknown statistic is the mean."""
    if stat == "median":
        g = quantiles(df, [y], (0.5,), [x]).select(x, F.get("q", F.lit(0)).alias("value"))
    else:
        g = df.groupBy(x).agg(STATISTICS.get(stat, F.avg)(y).alias("value"))
    return g.withColumn("reached", F.col("value") >= threshold) if threshold is not None else g


def all_statistics(df: DataFrame, categories: Sequence[str], values: Sequence[str], digits: int = 1) -> DataFrame:
    """(category, level, variable, statistic, value) of every category and numeric column, from one aggregate over grouping sets; medians are exact."""
    sets = [[c] for c in categories]
    d = df.select(*[F.col(c).cast("string").alias(c) for c in categories], *[F.col(v).cast("double").alias(v) for v in values])
    stats = {s: f for s, f in STATISTICS.items() if s != "median"} | {"count": F.count}
    g = d.groupingSets(sets, *categories).agg(F.grouping_id(*categories).alias("__set"), *[f(v).cast("double").alias(f"{v}.{s}") for v in values for s, f in stats.items()])
    full = (1 << len(categories)) - 1
    which = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (full - (1 << (len(categories) - 1 - i)), c)])
    g = g.withColumn("category", F.element_at(which, F.col("__set").cast("int"))).withColumn("level", F.coalesce(*categories))
    long = g.unpivot(["category", "level"], [f"`{v}.{s}`" for v in values for s in stats], "name", "value")
    out = long.select("category", "level", F.regexp_replace(F.substring_index("name", ".", 1), "`", "").alias("variable"), F.regexp_replace(F.substring_index("name", ".", -1), "`", "").alias("statistic"), F.round("value", digits).alias("value"))
    for c in categories:
        q = quantiles(d, values, (0.5,), [c])
        out = out.unionByName(q.select(F.lit(c).alias("category"), F.col(c).alias("level"), "variable", F.lit("median").alias("statistic"), F.round(F.get("q", F.lit(0)), digits).alias("value")))
    return out


def described_heat(df: DataFrame, columns: Sequence[str], group: str, stats: Sequence[str] = ("mean",), within: bool = False) -> DataFrame:
    """(group, variable, statistic, value, relative_rank): ranks of the values, ties at their mean, over the number of values (of the statistic, with ``within``)."""
    f = {**STATISTICS, "skewness": F.skewness, "kurtosis": lambda c: F.kurtosis(c) + 3}
    long = df.select(F.col(group).alias("group"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["group"], list(columns), "variable", "x")
    g = long.groupBy("group", "variable").agg(*[f[s]("x").alias(s) for s in stats]).unpivot(["group", "variable"], list(stats), "statistic", "value")
    part = Window.partitionBy("statistic") if within else Window.partitionBy()
    ties = Window.partitionBy("statistic", "value") if within else Window.partitionBy("value")
    average = F.rank().over(part.orderBy("value")) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return g.withColumn("relative_rank", average / F.count(F.lit(1)).over(part))


def abbreviated(x: Column) -> Column:
    """1.5K, 2.0M and so on; numbers below a thousand, and negative ones, as they are."""
    out = F.when(x < 1000, x.cast("string"))
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        out = out.when(x >= size, F.concat(F.round(x / size, 1).cast("string"), F.lit(unit)))
    return out


def dot_grid(df: DataFrame, column: str, facet: str) -> DataFrame:
    """A hundred dots per facet, as many filled as the rounded percentage of ones."""
    p = df.groupBy(facet).agg(F.round(100 * F.avg((F.col(column) == 1).cast("int"))).cast("int").alias("pct"))
    return p.withColumn("dot", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumn("filled", F.col("dot") <= F.col("pct"))


def group_lines(df: DataFrame, x: str, y: str, group: str, per_panel: int = 25) -> DataFrame:
    """Slope, intercept and r2 of y on x per group, the line at both ends of its x, and the group's panel."""
    g = df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.min(x).alias("x0"), F.max(x).alias("x1"))
    g = g.withColumn("y0", F.col("intercept") + F.col("slope") * F.col("x0")).withColumn("y1", F.col("intercept") + F.col("slope") * F.col("x1"))
    return g.withColumn("panel", F.ceil(F.dense_rank().over(Window.orderBy(group)) / per_panel).cast("int"))  # over groups


def title_case(text: Column) -> Column:
    """Underscores as blanks and a capital at the start of each word; the rest of a word stays."""
    words = F.split(F.replace(text, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def rename_items(df: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """``item`` by its text, with ``position``, the place of the item in the order given; items without a text stay as they are, last."""
    names, places = (F.create_map(*[F.lit(x) for i, (k, v) in enumerate(texts.items()) for x in (k, v if which else i + 1)]) for which in (True, False))
    return df.withColumn("position", F.coalesce(F.try_element_at(places, F.col("item")), F.lit(len(texts) + 1))).withColumn("item", F.coalesce(F.try_element_at(names, F.col("item")), F.col("item")))


def sort_items(df: DataFrame) -> DataFrame:
    """Rows from the last item to the first, as bars are drawn from below."""
    return df.orderBy(F.desc("position"), "item")


def filled_series(df: DataFrame, time_col: str, first: str, second: str) -> DataFrame:
    """(time, first, second, low, high, top): the span between two series and the name of the upper one, the second where they are equal."""
    top = F.when(F.col(first) <= F.col(second), F.lit(second)).when(F.col(first) > F.col(second), F.lit(first))
    return df.select(time_col, first, second, F.least(first, second).alias("low"), F.greatest(first, second).alias("high"), top.alias("top"))


def smooth_bins(df: DataFrame, x: str, y: str, color: str | None = None, bins: int = 20) -> DataFrame:
    """(color, bin, n, x, y, low, high): mean of y over bins of equal numbers of rows in the order of x, with the 95 % band of the mean.

    What a smooth curve through a scatter shows, at any number of rows; cuts are the exact quantiles of x over all groups.
    """
    cuts = quantile_values(df.where(F.col(y).isNotNull()), [x], [i / bins for i in range(1, bins)])[x]
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bin", sum(((F.col(x) > F.lit(c)).cast("int") for c in cuts), F.lit(1)))
    half = 1.96 * F.stddev_samp(y) / F.sqrt(F.count(F.lit(1)))
    return d.groupBy(*([color] if color else []), "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), (F.avg(y) - half).alias("low"), (F.avg(y) + half).alias("high"))
