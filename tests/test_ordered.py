"""Quantiles, ranks, running totals, blocks and neighbours against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import core, ordered
from loomwork.operators import neighbours, profiling, timeseries


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, x double")


@pytest.mark.parametrize(("few", "bracket", "values"), [(200_000, 1 / 1000, 0), (0, 1 / 1000, 0), (0, 0.05, 0), (200_000, 1.0, 0), (200_000, 1 / 1000, 10_000)])
def test_quantiles_equal_numpy(spark, monkeypatch, few, bracket, values):
    monkeypatch.setattr(ordered, "FEW_ROWS", few)
    monkeypatch.setattr(ordered, "FEW_VALUES", values)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 5.0, rng.gauss(0, 1), rng.paretovariate(0.3), -1e300])) for _ in range(4000)] + [("one", 2.0), ("none", None)]
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: r for r in ordered.quantiles(table(spark, rows), ["x"], ps, ["g"], bracket).collect()}
    assert set(got) == {"a", "b", None, "one", "none"} and got["none"]["n"] == 0 and got["none"]["q"] is None
    for g in ("a", "b", None, "one"):
        x = np.array([v for k, v in rows if k == g and v is not None])
        assert got[g]["n"] == len(x) and got[g]["q"] == pytest.approx(np.quantile(x, ps).tolist(), rel=1e-12)
    whole = np.array([v for _, v in rows if v is not None])
    for known in ((), ("y",)):
        both = ordered.quantile_values(table(spark, rows), {"y": F.col("x") * 2, "z": -F.col("x")}, [0.5, 0.2], known)
        assert both["y"] == pytest.approx((2 * np.quantile(whole, [0.5, 0.2])).tolist()) and both["z"] == pytest.approx(np.quantile(-whole, [0.5, 0.2]).tolist())


def test_quantiles_widen_brackets_that_miss(spark, monkeypatch):
    real = F.percentile_approx
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda x, p, a: F.transform(real(x, p, a), lambda v: F.lit(1e9)))
    assert ordered.quantile_values(table(spark, [("a", float(i)) for i in range(101)]), ["x"], [0.3])["x"] == [30.0]


def test_quantiles_of_nothing(spark):
    assert ordered.quantile_values(table(spark, []), ["x"], [0.5]) == {"x": [None]}
    assert ordered.quantiles(table(spark, []), ["x"], [0.5], ["g"]).count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_running_totals_and_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW_ROWS", few)
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), float(rng.randrange(200)), i) for i in range(2000)]
    d = spark.createDataFrame(rows, "g string, x double, v long")
    got = ordered.running_before(d, ["x", "v"], "v", ["g"]).collect()
    assert len(got) == 2000
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"], r["v"])):
            assert r["before"] == total
            total += r["v"]
    assert sorted(r["__rn"] for r in ordered.numbered(d, ["v"]).collect()) == list(range(1, 2001))
    ranks = {r["x"]: (r["ties"], r["rank"]) for r in ordered.average_ranks(d, "x").collect()}
    xs = sorted(x for _, x, _ in rows)
    assert all(ranks[x] == (xs.count(x), xs.index(x) + (xs.count(x) + 1) / 2) for x in set(xs))


def test_windows_in_blocks_equal_whole_windows(spark):
    d = spark.createDataFrame([(i, float(i * i % 17)) for i in range(1, 101)], "__rn long, x double")
    w = Window.partitionBy("__block").orderBy("__rn").rowsBetween(-3, 2)
    got = {r["__rn"]: r["s"] for r in ordered.in_blocks(d, 3, 2, block=7).withColumn("s", F.sum("x").over(w)).where("__own").collect()}
    x = [0.0] + [float(i * i % 17) for i in range(1, 101)]
    assert got == {i: sum(x[max(1, i - 3) : i + 3]) for i in range(1, 101)}


def test_series_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered.in_blocks, "__defaults__", (0, 0, 8, "__rn"))
    rng = random.Random(5)
    x = [rng.random() * 10 for _ in range(57)]
    x[20] = 500.0
    d = spark.createDataFrame(list(enumerate(x)), "t int, x double")
    w = timeseries.adstock_weights(4, 0.6)
    got = {r["t"]: r["adstock"] for r in timeseries.adstock(d, "t", "x", 4, 0.6, pad=True).collect()}
    pad = [0.0] * 3 + x
    assert [got[i] for i in range(57)] == pytest.approx([sum(w[j] * pad[i + j] for j in range(4)) for i in range(57)])
    fixed = {r["t"]: r["repaired"] for r in timeseries.hampel(d, "t", "x").collect()}
    assert fixed[20] == sorted(x[17:24])[3] and len(fixed) == 57

    def fold_error(lag, decay, folds=10):
        n, errors, w = len(x), [], timeseries.adstock_weights(lag, decay)
        size = n // folds
        for k in range(folds):
            rest = x[: k * size] + x[(k + 1) * size :]
            p = [0.0] * (lag - 1) + rest
            a = [sum(w[j] * p[i + j] for j in range(lag)) for i in range(len(rest))]
            b, c = np.polyfit(range(1, len(rest) + 1), a, 1)
            errors.append(sum((x[k * size + i] - (c + b * (len(rest) + 1 + i))) ** 2 for i in range(size)))
        return np.mean(errors)

    assert timeseries.trend_forecast_error(d, "t", "x", 3, 0.5).first()[0] == pytest.approx(fold_error(3, 0.5))
    grid = {(r["lag"], r["decay"]): (r["error"], r["best"]) for r in timeseries.grid_search(d, "t", "x", [2, 5], [0.3, 0.9]).collect()}
    assert {k: v[0] for k, v in grid.items()} == pytest.approx({k: fold_error(*k) for k in grid}) and [k for k, v in grid.items() if v[1]] == [min(grid, key=lambda k: grid[k][0])]
    assert timeseries.trend_forecast_error(d.limit(3), "t", "x", 3, 0.5).first()[0] is None


@pytest.mark.parametrize(("last", "ties"), [(10_000, False), (0, False), (0, True)])
def test_nearest_rows_equal_brute_force(spark, monkeypatch, last, ties):
    monkeypatch.setattr(neighbours, "LAST_ROWS", last)
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(50, 0.01, (60, 2)), np.repeat([[3.0, 3.0]], 12, 0), [[1e6, -1e6]]])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(999, None, 1.0)], "id int, a double, b double")
    got = {}
    for r in neighbours.nearest_rows(d, "id", ["a", "b"], 4, ties).collect():
        got.setdefault(r["id"], set()).add(r["o"])
    for i in range(len(p)):
        dist = np.sqrt(((p - p[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(p)), dist)) if j != i]
        want = {j for j in order if dist[j] <= dist[order[3]]} if ties else set(order[:4])
        assert got[i] == want
    assert neighbours.nearest_rows(d.limit(0), "id", ["a", "b"], 3).count() == 0
    assert neighbours.nearest_rows(d.where("id < 3"), "id", ["a", "b"], 5).count() == 6


def test_tables_are_dropped(spark):
    import os

    core.stored(spark.range(3))
    path = core.shared_dir(spark).removeprefix("file://")
    assert os.listdir(path)
    core.drop_stored(spark)
    assert not os.path.exists(path)


def test_statistics_by_kind(spark):
    d = spark.createDataFrame([(1, "a", "2024-01-01", "7", [1]), (2, None, "2024-01-03", "x", [2]), (2, "bb", None, None, [2])], "n int, s string, d string, t string, o array<int>")
    out = profiling.all_stats({"d": d}, {"d": {"d": "date", "t": "numeric", "n": "factor"}})["d"]
    assert out["numeric"].select("variable", "mean").collect() == [("t", 7.0)]
    assert sorted((r["level"], r["n"]) for r in out["factor"].collect()) == [("1", 1), ("2", 2)]
    assert str(out["date"].first()["last"]) == "2024-01-03"
    assert tuple(out["character"].first()) == ("s", 1, 3, 1.5, 2, 1) and tuple(out["other"].first()) == ("o", 0, 2)
    assert profiling.all_stats(d.select("s"), {"data": {"s": "numeric"}})["data"]["numeric"] is None
    with pytest.raises(ValueError, match="kind"):
        profiling.column_kinds(d, {"n": "odd"})
