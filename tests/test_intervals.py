"""Interval joins and calendars from events, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import ordered
from loomwork.operators import intervals


def spans(rng, n, most, length):
    return [(i, rng.choice([0, 0, 0, 1, 2, None]), a, a + rng.choice([0, 1, rng.randint(0, length), -3])) for i in range(n) for a in [rng.randint(-most, most)]]


def meets(x, y, keyed):
    ok = None not in (x[2], x[3], y[2], y[3]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    return ok and (not keyed or (x[1] is not None and x[1] == y[1]))


@pytest.mark.parametrize("keyed", [False, True])
def test_overlaps_equal_all_pairs(spark, keyed):
    rng = random.Random(1)
    a = [*spans(rng, 120, 300, 40), (500, 1, None, 4), (501, 1, 4, None), (502, 0, -300, 300), (503, 0, -(10**12), 10**12)]
    b = [*spans(rng, 120, 300, 300), (600, 1, 5, 5), (601, 0, 5, 5), (602, 0, 5, 5)]
    x, y = spark.createDataFrame(a, "i int, k int, s long, e long"), spark.createDataFrame(b, "j int, k int, t int, u int")
    if not keyed:
        y = y.withColumnRenamed("k", "l")
    got = sorted((r["i"], r["j"]) for r in intervals.overlaps(x, y, ("s", "e"), ("t", "u"), ["k"] if keyed else []).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if meets(p, q, keyed))
    assert got == want and len(want) > 300
    counts = {r["i"]: r["overlaps"] for r in intervals.overlap_counts(x, y, ("s", "e"), ("t", "u"), ["k"] if keyed else []).collect()}
    assert counts == {p[0]: sum(meets(p, q, keyed) for q in b) for p in a}


def test_overlap_counts_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW_ROWS", 10)
    rng = random.Random(2)
    a, b = spans(rng, 80, 100, 30), spans(rng, 90, 100, 60)
    x, y = spark.createDataFrame(a, "i int, k int, s long, e long"), spark.createDataFrame(b, "j int, k int, t int, u int")
    counts = {r["i"]: r["overlaps"] for r in intervals.overlap_counts(x, y, ("s", "e"), ("t", "u"), ["k"]).collect()}
    assert counts == {p[0]: sum(meets(p, q, True) for q in b) for p in a}


def test_dates_and_timestamps(spark):
    day = lambda k: dt.date(1969, 12, 25) + dt.timedelta(days=k)
    a = spark.createDataFrame([(1, day(0), day(3)), (2, day(7), day(9000))], "i int, s date, e date")
    b = spark.createDataFrame([(1, day(3), day(3)), (2, day(4), day(6)), (3, day(9000), day(9001))], "j int, t date, u date")
    assert sorted(map(tuple, intervals.overlaps(a, b, ("s", "e"), ("t", "u")).select("i", "j").collect())) == [(1, 1), (2, 3)]
    stamp = [(1, "2020-01-01 00:00:00.000001", "2020-01-01 00:00:00.000003")], [(1, "2020-01-01 00:00:00.000003", "2020-01-02 00:00:00"), (2, "2020-01-01 00:00:00.000004", "2020-01-02 00:00:00")]
    c, d = (spark.createDataFrame(x, f"{i} int, s{i} string, e{i} string").withColumns({f"s{i}": F.to_timestamp(f"s{i}"), f"e{i}": F.to_timestamp(f"e{i}")}) for x, i in zip(stamp, "ij", strict=True))
    assert [tuple(r) for r in intervals.overlaps(c, d, ("si", "ei"), ("sj", "ej")).select("i", "j").collect()] == [(1, 1)]
    with pytest.raises(ValueError, match="columns of both"):
        intervals.overlaps(a, a, ("s", "e"), ("s", "e"))
    with pytest.raises(ValueError, match="whole numbers"):
        intervals.overlaps(a.withColumn("x", F.lit(1.5)), b, ("x", "x"), ("t", "u"))
    empty = a.limit(0)
    assert intervals.overlaps(empty, b, ("s", "e"), ("t", "u")).count() == 0 and intervals.overlap_counts(empty, b, ("s", "e"), ("t", "u")).count() == 0


def test_long_intervals_are_few_rows(spark):
    """Blocks grow with the logarithm of the length; events are two an interval."""
    rows = spark.range(1000).select((F.col("id") * 7 + (1 << 61)).alias("s"), (F.col("id") * 7 + 10_000 + (1 << 61)).alias("e"))
    most = rows.select(F.size(intervals.dyadic_blocks("s", "e", 13)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 28
    whole = rows.limit(50).select("s", "e", F.inline(intervals.dyadic_blocks("s", "e", 13))).select("s", "e", F.expr("block * shiftleft(1L, level)").alias("from"), F.expr("shiftleft(1L, level)").alias("n"))
    for r in whole.groupBy("s", "e").agg(F.min("from").alias("a"), F.sum("n").alias("n"), F.max(F.col("from") + F.col("n")).alias("b")).collect():
        assert r["a"] == r["s"] and r["b"] == r["e"] + 1 and r["n"] == r["b"] - r["a"]
    d = spark.createDataFrame([(dt.date(1980, 1, 1) + dt.timedelta(days=k), dt.date(1980, 1, 1) + dt.timedelta(days=k + 10_000)) for k in range(40)], "s date, e date")
    assert intervals._events(d, "s", "e", [], {"n": F.lit(1)}).count() == 80
    got = {r["s"]: r["n"] for r in intervals.daily_counts(d, "s", "e").collect()}
    assert len(got) == 10_040 and got[dt.date(1980, 1, 1)] == 1 and got[dt.date(1980, 3, 1)] == 40


def test_calendars_equal_plain(spark):
    rng = random.Random(4)
    base = dt.date(2020, 2, 20)
    rows = [(rng.choice(["x", "y", None]), base + dt.timedelta(days=a), base + dt.timedelta(days=a + rng.randint(0, 5)), rng.choice([None, 0.1, 0.2, 1e9, -3.25])) for a in [rng.choice([0, 3, 60, 61]) + rng.randint(0, 4) for _ in range(40)]]
    d = spark.createDataFrame(rows, "g string, s date, e date, v double")
    first, last = min(r[1] for r in rows), max(r[2] for r in rows)
    days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    for how in ("sum", "mean", "median"):
        got = {(r["g"], r["day"]): r["value"] for r in intervals.daily_summary(d, "s", "e", "v", "g", how).collect()}
        for g in ("x", "y", None):
            for day in days:
                v = sorted(r[3] for r in rows if r[0] == g and r[1] <= day <= r[2] and r[3] is not None)
                want = 0.0 if not v else sum(v) if how == "sum" else sum(v) / len(v) if how == "mean" else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
                assert got[g, day] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert len(got) == 3 * len(days)
    counts = {(r["g"], r["s"]): r["n"] for r in intervals.daily_counts(d, "s", "e", "g").collect()}
    for g in ("x", "y", None):
        own = [r for r in rows if r[0] == g]
        a, b = min(r[1] for r in own), max(r[2] for r in own)
        assert {k: n for k, n in counts.items() if k[0] == g} == {(g, a + dt.timedelta(days=k)): sum(r[1] <= a + dt.timedelta(days=k) <= r[2] for r in own) for k in range((b - a).days + 1)}
    assert intervals.daily_counts(d.limit(0), "s", "e").count() == 0 and intervals.daily_summary(d.limit(0), "s", "e", "v", "g").count() == 0
    odd = spark.createDataFrame([("x", base, base, float("inf")), ("x", base, base, 1.0)], d.schema)
    assert intervals.daily_summary(odd, "s", "e", "v").first()["value"] == float("inf")
    with pytest.raises(Exception, match="start dates must be"):
        intervals.daily_counts(spark.createDataFrame([("x", last, first, 1.0)], d.schema), "s", "e").collect()


def test_small_groups_meet_without_blocks(spark, monkeypatch):
    rng = random.Random(3)
    a, b = spans(rng, 150, 100, 30), [(i, 3 if i % 9 == 0 else k, s, e) for i, k, s, e in spans(rng, 130, 100, 60)]
    a += [(900, 3, 0, 50), (901, 3, -5, 5)]  # a group with few on one side only
    x, y = spark.createDataFrame(a, "i int, k int, s long, e long"), spark.createDataFrame(b, "j int, k int, t int, u int")
    want = sorted((p[0], q[0]) for p in a for q in b if meets(p, q, True))
    for few, generates in ((1000, False), (8, True), (0, True)):
        monkeypatch.setattr(intervals, "FEW_OF_A_SIDE", few)
        got = intervals.overlaps(x, y, ("s", "e"), ("t", "u"), ["k"])
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
        assert ("Generate" in got._jdf.queryExecution().executedPlan().toString()) == generates
