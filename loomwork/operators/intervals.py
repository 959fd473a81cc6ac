"""Intervals: overlap joins by dyadic blocks, and counts and summaries on a calendar from events at their ends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.core import require_columns, stored
from loomwork.functions.ordered import quantiles

#: Groups of which one side has at most so many intervals are joined without blocks.
FEW_OF_A_SIDE = 64
_ENDS = "start dates must be less than or equal to end dates"


def expand_days(df: DataFrame, start_col: str, end_col: str, day_col: str = "day") -> DataFrame:
    """A row per day of each interval, both ends included; null ends or a start after its end raise when run."""
    require_columns(df, [start_col, end_col])
    start, end = F.to_date(start_col), F.to_date(end_col)
    good = F.when(start <= end, F.sequence(start, end)).otherwise(F.raise_error(F.lit(_ENDS)).cast("array<date>"))
    return df.withColumn(day_col, F.explode(good))


# ---- joins ---------------------------------------------------------------------------------------


def _place(df: DataFrame, column: str) -> Column:
    """A date, timestamp or whole number as a long on its axis, from 0 at the lowest long that is used (half of all)."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        x = F.unix_date(column).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        x = F.unix_micros(F.col(column).cast("timestamp"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        x = F.col(column).cast("long")
    else:
        raise ValueError(f"{column}: intervals are of dates, timestamps or whole numbers, not {kind.simpleString()}")
    return x + F.lit(1 << 61)


def dyadic_blocks(start: str, end: str, levels: int) -> Column:
    """The fewest blocks of 2^level places, aligned to their size, that make up the places from ``start`` up to ``end``: at most two a level.

    Every place of the interval is in exactly one of them. An array of (level, block); none where ``end`` is before ``start``.
    """
    low, high = f"shiftright({start} + shiftleft(1L, l) - 1, l)", f"shiftright({end} + 1, l)"
    pair = f"array(CASE WHEN {low} < {high} AND {low} % 2 = 1 THEN struct(l AS level, {low} AS block) END, CASE WHEN {low} < {high} AND {high} % 2 = 1 THEN struct(l AS level, {high} - 1 AS block) END)"
    return F.expr(f"filter(flatten(transform(sequence(0, {levels}), l -> {pair})), x -> x IS NOT NULL)")


def overlaps(left: DataFrame, right: DataFrame, left_span: Sequence[str], right_span: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All pairs of a left and a right row whose closed intervals have a place in common (and that agree in ``by``), each once; all columns of both.

    Ends are dates, timestamps (to the microsecond) or whole numbers. Two intervals meet if the right one starts inside the left
    one, or the left one starts inside the right one and later: both are joins of points with intervals. An interval is cut into
    dyadic blocks, at most two for each doubling of its length, and a point looks into the one block of each size that is
    in use; a point inside an interval is in exactly one of its blocks. So rows grow with the logarithm of the lengths, not
    with the lengths. Groups ``by`` of which one side has at most ``FEW_OF_A_SIDE`` rows are joined as they are: that forms fewer pairs
    a row than that, and needs no row per block. In all others no pair is formed that isn't a result. Rows with null ends, a start after its end, or a
    null in ``by`` meet none. Column names beyond ``by`` must differ.
    """
    require_columns(left, [*left_span, *by])
    require_columns(right, [*right_span, *by])
    if clash := (set(left.columns) & set(right.columns)) - set(by):
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")

    def placed(df: DataFrame, span: Sequence[str]) -> DataFrame:
        d = df.dropna(subset=list(by)) if by else df
        d = d.withColumn("__s", _place(df, span[0])).withColumn("__e", _place(df, span[1]))
        return d.where("__s <= __e")

    a, b = placed(left, left_span), placed(right, right_span)
    out = [*by, *[c for c in left.columns if c not in by], *[c for c in right.columns if c not in by]]
    small = None
    if by:
        ends = {"__s": "__t", "__e": "__f"}
        sides = a.select(*by, F.lit(1).alias("__a"), F.lit(0).alias("__b")).union(b.select(*by, F.lit(0), F.lit(1)))
        sides = sides.groupBy(*by).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
        large = stored(sides.where(F.least("__a", "__b") > FEW_OF_A_SIDE).select(*by))
        none = large.isEmpty()
        c, d = (a, b) if none else (x.join(large, list(by), "left_anti") for x in (a, b))
        small = c.join(d.withColumnsRenamed(ends), list(by)).where("__s <= __f AND __t <= __e").select(out)
        if none:
            return small
        a, b = (x.join(large, list(by), "left_semi") for x in (a, b))
    longest = [d.agg(F.max(F.col("__e") - F.col("__s") + 1)).first()[0] or 1 for d in (a, b)]

    def inside(points: DataFrame, spans: DataFrame, length: int, strictly: bool) -> DataFrame:
        """Pairs where a point's start lies in a span, after its start if ``strictly``."""
        levels = max(0, math.floor(math.log2(length)))
        keys = F.expr(f"transform(sequence(0, {levels}), l -> struct(l AS level, shiftright(__s, l) AS block))")
        p = points.select(*[c for c in points.columns if c not in ("__s", "__e")], F.inline(keys))
        first = "__s + 1" if strictly else "__s"
        s = spans.select(*[c for c in spans.columns if c not in ("__s", "__e")], F.inline(dyadic_blocks(f"({first})", "__e", levels)))
        return p.join(s, [*by, "level", "block"])

    met = inside(b, a, longest[0], False).select(out).unionByName(inside(a, b, longest[1], True).select(out))
    return met if small is None else small.unionByName(met)


# ---- calendars -----------------------------------------------------------------------------------


def _events(df: DataFrame, start_col: str, end_col: str, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys, day, values): what starts on a day less what has ended by it; two rows an interval however long it is, added up before they are shuffled."""
    start, end = F.to_date(start_col), F.to_date(end_col)
    ends = F.when(start <= end, F.array(F.struct(start.alias("day"), F.lit(1).alias("__d")), F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("__d")))).otherwise(F.raise_error(F.lit(_ENDS)).cast("array<struct<day:date,__d:int>>"))
    rows = df.select(*keys, *[v.alias(n) for n, v in values.items()], F.inline(ends))
    return rows.groupBy(*keys, "day").agg(*[F.sum(F.col(n) * F.col("__d")).alias(n) for n in values])


def _by_day(events: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A row per day from each key's first event up to the day before its last one, with the running totals; the order runs over the days of events."""
    order = Window.partitionBy(*keys).orderBy("day")
    pieces = events.select(*keys, "day", F.date_sub(F.lead("day").over(order), 1).alias("__to"), *[F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names])
    return pieces.where("__to is not null").select(*keys, F.explode(F.sequence("day", "__to")).alias("day"), *names)


def daily_counts(df: DataFrame, start_col: str, end_col: str, group_col: str | None = None) -> DataFrame:
    """How many intervals cover each day, from the first start to the last end of each group, zeros included.

    An interval is one event where it starts and one after its end, whatever its length; running totals over the days
    give the counts. A null group is a group. Null ends or a start after its end raise when run.
    """
    require_columns(df, [start_col, end_col, group_col])
    keys = [group_col] if group_col else []
    days = _by_day(_events(df, start_col, end_col, keys, {"n": F.lit(1).cast("long")}), keys, ["n"])
    return days.select(*keys, F.col("day").alias(start_col), "n")


def daily_summary(df: DataFrame, start_col: str, end_col: str, value_col: str, group_col: str | None = None, how: str = "sum") -> DataFrame:
    """The sum, mean or median of the values of the intervals that cover each day, for each group on one common calendar; no values give 0.

    Sums and means come from running totals of events (see ``daily_counts``), in decimals of as many places as the largest sum leaves of 38, at
    most 18, so that what has ended leaves nothing behind. A median needs the values of each day: a row per day and interval, as do values that aren't finite.
    """
    require_columns(df, [start_col, end_col, value_col, group_col])
    if how not in ("sum", "mean", "median"):
        raise ValueError(f"no such summary: {how}")
    keys = [group_col] if group_col else []
    value = F.col(value_col).cast("double")
    bounds = df.agg(F.min(F.to_date(start_col)).alias("a"), F.max(F.to_date(end_col)).alias("b"), F.sum(F.abs(value)).alias("all")).first()
    total = bounds["all"] or 0.0
    if how == "median" or not math.isfinite(total) or total >= 1e36:
        return _expanded_summary(df, start_col, end_col, value_col, keys, how)
    scale = min(18, 37 - max(1, math.ceil(math.log10(total + 1)) + 1))
    exact = F.coalesce(value, F.lit(0.0)).cast(f"decimal(38,{scale})")
    events = _events(df, start_col, end_col, keys, {"v": exact, "n": value.isNotNull().cast("long")})
    if bounds["a"] is not None:  # every group has the whole calendar
        edges = events.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(bounds["a"]), F.date_add(F.lit(bounds["b"]), 1))).alias("day"), F.lit(0).cast(events.schema["v"].dataType).alias("v"), F.lit(0).cast("long").alias("n"))
        events = events.unionByName(edges).groupBy(*keys, "day").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    days = _by_day(events, keys, ["v", "n"])
    out = F.col("v").cast("double") if how == "sum" else F.when(F.col("n") > 0, F.col("v").cast("double") / F.col("n")).otherwise(0.0)
    return days.select(*keys, "day", out.alias("value"))


def _expanded_summary(df: DataFrame, start_col: str, end_col: str, value_col: str, keys: Sequence[str], how: str) -> DataFrame:
    each = expand_days(df, start_col, end_col)
    if how == "median":
        days = quantiles(each, [value_col], (0.5,), [*keys, "day"]).select(*keys, "day", F.get("q", F.lit(0)).alias("value"))
    else:
        days = each.groupBy(*keys, "day").agg({"sum": F.sum, "mean": F.avg}[how](value_col).alias("value"))
    bounds = df.agg(F.min(F.to_date(start_col)).alias("a"), F.max(F.to_date(end_col)).alias("b"))
    calendar = bounds.select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = df.select(*keys).distinct().crossJoin(calendar) if keys else calendar  # groups x days, the size of the result
    named = days.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("day").alias("__day"), "value")
    on = grid["day"] == named["__day"]
    for k in keys:
        on = on & grid[k].eqNullSafe(named[f"__{k}"])
    return grid.join(named, on, "left").select(*keys, "day", F.coalesce("value", F.lit(0.0)).alias("value"))


def overlap_counts(left: DataFrame, right: DataFrame, left_span: Sequence[str], right_span: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``left`` with ``overlaps``: how many right intervals each of its own meets, without forming the pairs.

    A right interval meets all but those that start after its end and those that end before its start: of a left row's right side, the
    starts up to its end less the ends before its start. Starts and ends are counted by place, and totals run over the places that
    occur in ranges (see ``running_before``). Null or reversed intervals, and nulls in ``by``, meet none.
    """
    from loomwork.functions.ordered import running_before

    require_columns(left, [*left_span, *by])
    require_columns(right, [*right_span, *by])
    rows = stored(left.withColumn("__row", F.monotonically_increasing_id()))
    asks = rows.select("__row", *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], _place(left, left_span[0]).alias("s"), _place(left, left_span[1]).alias("e")).where("s <= e").dropna(subset=[f"k{i}" for i in range(len(by))])
    held = right.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], _place(right, right_span[0]).alias("s"), _place(right, right_span[1]).alias("e")).where("s <= e").dropna(subset=[f"k{i}" for i in range(len(by))])
    keys = [f"k{i}" for i in range(len(by))]
    # places in order: of equal ones starts count for an end that asks, ends don't for a start that asks
    events = held.select(*keys, F.inline(F.array(F.struct(F.col("s").alias("at"), F.lit(0).alias("o"), F.lit(1).alias("d"), F.lit(0).alias("u")), F.struct((F.col("e") + 1).alias("at"), F.lit(0).alias("o"), F.lit(0).alias("d"), F.lit(1).alias("u")))))
    events = events.groupBy(*keys, "at", "o").agg(F.sum("d").alias("d"), F.sum("u").alias("u")).withColumn("__row", F.lit(None).cast("long")).withColumn("end", F.lit(None).cast("boolean"))
    ask = asks.select(*keys, F.inline(F.array(F.struct(F.col("s").alias("at"), F.lit(False).alias("end")), F.struct(F.col("e").alias("at"), F.lit(True).alias("end")))), "__row").withColumn("o", F.lit(1)).withColumn("d", F.lit(0).cast("long")).withColumn("u", F.lit(0).cast("long"))
    started = running_before(events.unionByName(ask), ["at", "o"], "d", keys, "starts")
    ended = running_before(started, ["at", "o"], "u", keys, "ends")
    counts = ended.where("`end` is not null").groupBy("__row").agg((F.sum(F.when(F.col("end"), F.col("starts")).otherwise(0)) - F.sum(F.when(~F.col("end"), F.col("ends")).otherwise(0))).cast("long").alias("overlaps"))
    return rows.join(counts, "__row", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)).cast("long")).drop("__row")
