"""Quantiles, ranks, running totals and neighbours in an order, exact and without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import stored

#: A bracket around a quantile reaches this share of the ranks to either side; its approximate ends are exact to a tenth of that.
BRACKET = 1 / 1000
#: Rows of one block of a numbered table.
BLOCK = 1 << 20
#: A counted table of at most so many rows is ordered by one task (per group); beyond, ranges of it are.
FEW_ROWS = 200_000
#: Columns of at most about so many distinct values are counted value by value in one aggregate, whose buffers that bounds.
FEW_VALUES = 10_000


def _same(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(left, right, strict=True):
        out = out & a[x].eqNullSafe(b[y])
    return out


def running_before(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (), out: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one in ``order``, per ``by``.

    Beyond FEW_ROWS, rows are dealt to tasks by ranges of the order and written; each task sums its own
    range, and the sums of whole ranges (one row per range and group) give what lies before it. Rows with
    equal order keys come in any order; nulls come first.
    """
    spark = df.sparkSession
    df = stored(df)
    if df.count() <= FEW_ROWS:
        whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    keys = [f"__range_by{i}" for i in range(len(by))]
    totals = parts.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("__part").alias("__range")).agg(F.sum(value).alias("__t"))
    earlier = F.sum("__t").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(*keys, "__range", earlier.alias("__base"))  # at most a row per range and group
    joined = parts.withColumn("__in", inside)
    joined = joined.join(base, _same(joined, base, [*by, "__part"], [*keys, "__range"]), "left")
    return joined.withColumn(out, F.coalesce("__in", F.lit(0)) + F.coalesce("__base", F.lit(0))).drop("__in", "__base", "__part", "__range", *keys)


def numbered(df: DataFrame, order: Sequence[str], out: str = "__rn") -> DataFrame:
    """``df`` with row numbers from 1 in ``order``."""
    d = running_before(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out=out)
    return d.withColumn(out, F.col(out) + 1).drop("__one")


def in_blocks(df: DataFrame, back: int = 0, ahead: int = 0, block: int = BLOCK, number: str = "__rn") -> DataFrame:
    """A numbered table with ``__block`` and ``__own``: windows by block see ``back`` rows before and ``ahead`` rows after each own row.

    Rows near a block's ends are copied to the blocks beside it with ``__own`` false; drop them after the window.
    """
    if max(back, ahead) > block:
        raise ValueError("a window must not be longer than a block")
    at, r = F.floor((F.col(number) - 1) / block).cast("long"), F.pmod(F.col(number) - 1, F.lit(block))
    blocks = F.array(at, F.when(r >= block - back, at + 1), F.when((r < ahead) & (at > 0), at - 1))
    return df.withColumn("__block", F.explode(F.array_compact(blocks))).withColumn("__own", F.col("__block") == at)


def ranks_of_counts(counts: DataFrame) -> DataFrame:
    """(x, ties, rank) of a table with a row per value ``x`` and how often it occurs, ``ties``: ties share their mean rank."""
    return running_before(counts, ["x"], "ties").select("x", "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("rank"))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(x, ties, rank) of distinct known values: ties share their mean rank."""
    return ranks_of_counts(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("ties")))


def _rows_and_bounds(df: DataFrame, named: Mapping[str, Column], keys: Sequence[str], by: Sequence[str], ends: Sequence[float], bracket: float) -> tuple[DataFrame, DataFrame]:
    """The columns as ``x0``, ``x1``... beside the groups, and per group the known values of each and its approximate quantiles at ``ends``."""
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[x.cast("double").alias(f"x{i}") for i, x in enumerate(named.values())])
    probes = F.array(*[F.lit(e) for e in ends])
    aggs = [a for i in range(len(named)) for a in (F.count(f"x{i}").alias(f"n{i}"), F.percentile_approx(f"x{i}", probes, int(10 / bracket)).alias(f"e{i}"))]
    return rows, rows.groupBy(*keys).agg(*aggs)


def _counted(rows: DataFrame, keys: Sequence[str], columns: int, brackets: int, ends: Mapping[int, Column] | None) -> DataFrame:
    """(keys, i, v, gap, count): how often each value inside a bracket of its column occurs, and how many lie in each gap, named by the bracket's end before it.

    ``ends`` has the brackets' ends of each column in turn, as arrays; without it every value is counted.
    """

    def place(i: int) -> Column:
        x = F.col(f"x{i}")
        if ends is None:
            return F.struct(F.lit(i).alias("i"), x.alias("v"), F.lit(0).alias("gap"))
        end = lambda j: F.get(ends[i], F.lit(j))
        inside = F.lit(False)
        passed = [F.lit(float("-inf"))]
        for j in range(0, 2 * brackets, 2):
            inside = inside | x.between(end(j), end(j + 1))
            passed.append(F.when(x > end(j + 1), end(j + 1)))
        return F.struct(F.lit(i).alias("i"), F.when(inside, x).otherwise(F.greatest(*passed)).alias("v"), (~inside).cast("int").alias("gap"))

    placed = rows.select(*keys, F.explode(F.array(*[F.when(F.col(f"x{i}").isNotNull(), place(i)) for i in range(columns)])).alias("s")).where("s is not null")
    return placed.groupBy(*keys, F.col("s.i").alias("i"), F.col("s.v").alias("v"), F.col("s.gap").alias("gap")).agg(F.count(F.lit(1)).alias("count"))


def _named(columns: Sequence[str] | Mapping[str, Column]) -> dict[str, Column]:
    return dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}


def quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probabilities: Sequence[float], by: Sequence[str] = (), bracket: float = BRACKET) -> DataFrame:
    """(by, variable, n, q): the number of known values of each column and group, and its exact quantiles, interpolated linearly.

    Approximate quantiles, of bounded memory, bracket each rank; a second pass counts the values inside the
    brackets one by one and all others by the gap they lie in; running totals over those few find the order
    statistics. Where a bracket misses its rank, it is widened. Where all columns have few distinct values, one aggregate per
    group counts them all. Groups without known values have n = 0 and no quantiles.
    """
    named = _named(columns)
    if not by:
        found = _whole_quantiles(df, named, probabilities, bracket)
        return df.sparkSession.createDataFrame([(c, n, q) for c, (n, q) in found.items()], "variable string, n long, q array<double>")
    if max(df.agg(*[F.approx_count_distinct(x) for x in named.values()]).first()) <= FEW_VALUES:
        which = F.array(*[F.lit(float(p)) for p in probabilities])
        each = [F.struct(F.lit(c).alias("variable"), F.count(x).alias("n"), F.percentile(x.cast("double"), which).alias("q")) for c, x in named.items()]
        return df.groupBy(*by).agg(F.array(*each).alias("__rows")).select(*by, F.inline("__rows"))
    ps = sorted(set(probabilities))
    names, keys = list(named), [f"__by{i}" for i in range(len(by))]
    ends = [e for p in ps for e in (max(0.0, p - bracket), min(1.0, p + bracket))]
    rows, bounds = _rows_and_bounds(df, named, keys, by, ends, bracket)
    bounds = stored(bounds)
    other = bounds.withColumnsRenamed({k: f"__o{k}" for k in keys})
    with_ends = rows.join(other, _same(rows, other, keys, [f"__o{k}" for k in keys])).drop(*[f"__o{k}" for k in keys])
    counts = _counted(with_ends, keys, len(names), len(ps), {i: F.col(f"e{i}") for i in range(len(names))} if bracket < 1 else None)
    counts = running_before(counts, ["v", "gap"], "count", [*keys, "i"])
    long = bounds.select(*keys, F.posexplode(F.array(*[F.col(f"n{i}") for i in range(len(names))])).alias("i", "n"))
    long_keys = [f"__l{k}" for k in [*keys, "i"]]
    totals = long.withColumnsRenamed(dict(zip([*keys, "i"], long_keys, strict=True)))
    found = counts.join(totals, _same(counts, totals, [*keys, "i"], long_keys), "inner")
    got = []
    for j, p in enumerate(ps):
        h = (F.col("n") - 1) * F.lit(float(p))
        for name, k in (("a", F.floor(h)), ("b", F.ceil(h))):
            got.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("count")), F.struct("gap", "v"))).alias(f"{name}{j}"))
    found = stored(found.groupBy(*keys, "i", "n").agg(*got))
    missed = F.lit(False)
    for j in range(len(ps)):
        for name in "ab":
            missed = missed | F.coalesce(F.col(f"{name}{j}.gap") == 1, F.lit(True))
    if bracket < 1 and not found.where(missed).isEmpty():
        return quantiles(df, columns, probabilities, by, min(1.0, bracket * 50))
    between = {}
    for j, p in enumerate(ps):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"a{j}.v"), F.col(f"b{j}.v")
        between[p] = F.when(lo == hi, lo).otherwise(lo + (h - F.floor(h)) * (hi - lo))
    found = found.select(*[F.col(k).alias(f"__f{k}") for k in keys], F.col("i").alias("__fi"), F.array(*[between[p] for p in probabilities]).alias("q"))
    out = long.join(found, _same(long, found, [*keys, "i"], [*[f"__f{k}" for k in keys], "__fi"]), "left")
    variable = F.get(F.array(*[F.lit(c) for c in names]), F.col("i"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], variable.alias("variable"), "n", "q")


def _whole_quantiles(df: DataFrame, named: Mapping[str, Column], probabilities: Sequence[float], bracket: float = BRACKET, few: Collection[str] = ()) -> dict[str, tuple[int, list[float] | None]]:
    """(n, quantiles) of whole columns by the same two passes; at most FEW_ROWS counts come to the driver, more are added up by ``quantiles`` over one group.

    ``few`` names columns that are known to have at most about FEW_VALUES distinct values: one aggregate counts them all.
    """
    counted = {c: x for c, x in named.items() if c in few}
    if counted:
        which = F.array(*[F.lit(float(p)) for p in probabilities])
        s = df.agg(*[a for i, x in enumerate(counted.values()) for a in (F.count(x).alias(f"n{i}"), F.percentile(x.cast("double"), which).alias(f"q{i}"))]).first()
        known = {c: (s[f"n{i}"], s[f"q{i}"]) for i, c in enumerate(counted)}
        rest = _whole_quantiles(df, {c: x for c, x in named.items() if c not in few}, probabilities, bracket) if len(counted) < len(named) else {}
        return {c: (known | rest)[c] for c in named}
    ps = sorted(set(probabilities))
    ends = [e for p in ps for e in (max(0.0, p - bracket), min(1.0, p + bracket))]
    rows, bounds = _rows_and_bounds(df, named, [], [], ends, bracket)
    one = bounds.first()  # a few numbers per column and probability
    arrays = {i: F.array(*[F.lit(float(a)) for a in one[f"e{i}"]]) if one[f"e{i}"] is not None else F.lit(None).cast("array<double>") for i in range(len(named))}
    table = _counted(rows, [], len(named), len(ps), arrays if bracket < 1 else None).limit(FEW_ROWS + 1).toArrow()
    if table.num_rows > FEW_ROWS:
        grouped = quantiles(df.withColumn("__all", F.lit(0)), dict(named), probabilities, ["__all"], bracket).collect()
        return {r["variable"]: (r["n"], r["q"]) for r in grouped}
    column, value, gap, count = (table[c].to_numpy(zero_copy_only=False) for c in ("i", "v", "gap", "count"))
    out: dict[str, tuple[int, list[float] | None]] = {}
    for i, c in enumerate(named):
        n, own = one[f"n{i}"], np.flatnonzero(column == i)
        if not n:
            out[c] = (0, None)
            continue
        own = own[np.lexsort((gap[own], value[own]))]
        upto, got = np.cumsum(count[own]), {}
        for p in ps:
            h = (n - 1) * float(p)
            at = [own[int(np.searchsorted(upto, k, side="right"))] for k in (math.floor(h), math.ceil(h))]
            if gap[at].any():
                return _whole_quantiles(df, named, probabilities, min(1.0, bracket * 50))
            lo, hi = (float(value[a]) for a in at)
            got[p] = lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)
        out[c] = (n, [got[p] for p in probabilities])
    return out


def quantile_values(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probabilities: Sequence[float], few: Collection[str] = ()) -> dict[str, list[float | None]]:
    """The exact quantiles of whole columns as plain numbers, None for a column without known values; ``few`` names columns known to have few distinct values."""
    found = _whole_quantiles(df, _named(columns), probabilities, few=few)
    return {c: q if q is not None else [None] * len(probabilities) for c, (_, q) in found.items()}
