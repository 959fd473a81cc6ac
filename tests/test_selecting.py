"""Shuffled copies keep planted predictors and drop noise; sparse fits meet their conditions and equal refits by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions.ordered import numbered
from loomwork.operators import selecting

NAMES = ["a", "b", "n1", "n2", "n3"]


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(500, 5))
    y = 3 * x[:, 0] + 2 * np.abs(x[:, 1]) + r.normal(size=500) / 4
    return spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(None, *[1.0] * 5, None)], "id int, a double, b double, n1 double, n2 double, n3 double, y double")


def test_shadows_are_a_shuffle(spark, planted):
    d = numbered(planted.dropna(), ["id"])
    one, two, other = (selecting.shadow_table(d, ["a", "b"], s).orderBy("__rn").collect() for s in (1, 1, 2))
    assert one == two and one != other
    assert sorted((r["a"], r["b"]) for r in one) == sorted((r["s_a"], r["s_b"]) for r in one)
    assert sum(r["a"] == r["s_a"] for r in one) < 10


def test_planted_predictors_are_kept(planted):
    runs = [selecting.shadow_selection(planted, "id", "y", NAMES, rounds=12, trees=12).collect() for _ in range(2)]
    assert runs[0] == runs[1]
    decision = {r["feature"]: r["decision"] for r in runs[0]}
    assert decision["a"] == decision["b"] == "confirmed"
    assert "confirmed" not in {decision[n] for n in ("n1", "n2", "n3")} and "rejected" in {decision[n] for n in ("n1", "n2", "n3")}


def test_shadows_of_an_empty_table(planted):
    assert {(r["rounds"], r["decision"]) for r in selecting.shadow_selection(planted.limit(0), "id", "y", NAMES).collect()} == {(0, "tentative")}
    assert selecting._tail(0, 5) == 1 and selecting._tail(5, 5) == 1 / 32


def test_sparse_fit(planted):
    got = selecting.sparse_linear(planted, "id", "y", NAMES, folds=4, steps=30).collect()
    rows = planted.dropna().select(*NAMES, "y", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(4)).alias("fold")).toPandas()
    x, y = rows[NAMES].to_numpy(), rows["y"].to_numpy()

    def fit(x, y, penalty):
        xc, yc = x - x.mean(axis=0), y - y.mean()
        b = np.zeros(5)
        for _ in range(500):
            for j in range(5):
                pull = xc[:, j] @ (yc - xc @ b + xc[:, j] * b[j]) / len(y)
                b[j] = np.sign(pull) * max(abs(pull) - penalty, 0) / (xc[:, j] @ xc[:, j] / len(y))
        return b, y.mean() - x.mean(axis=0) @ b

    b = np.array([r["coefficient"] for r in got])
    penalty = got[0]["penalty"]
    slope = (x - x.mean(axis=0)).T @ (y - y.mean() - (x - x.mean(axis=0)) @ b) / len(y)
    assert all(abs(s - penalty * np.sign(v)) < 1e-9 if v else abs(s) <= penalty + 1e-9 for s, v in zip(slope, b, strict=True))
    top = np.abs((x - x.mean(axis=0)).T @ (y - y.mean()) / len(y)).max()
    errors = []
    for p in (grid := top * 10.0 ** np.linspace(0, -4, 30)):
        e = 0.0
        for f in range(4):
            own = rows["fold"].to_numpy() == f
            c, base = fit(x[~own], y[~own], p)
            e += ((y[own] - base - x[own] @ c) ** 2).sum()
        errors.append(e)
    assert penalty == pytest.approx(grid[int(np.argmin(errors))])
    assert got[0]["selected"] and b[0] == pytest.approx(3, abs=0.2)
    none = selecting.sparse_linear(planted.limit(0), "id", "y", NAMES).collect()
    assert [(r["coefficient"], r["selected"]) for r in none] == [(0.0, False)] * 5


def test_a_shuffle_moves_rows_twice_and_writes_nothing(spark, monkeypatch):
    written = []
    monkeypatch.setattr(selecting, "stored", lambda df: written.append(df))
    for rows in (1, 37, 5000):
        d = spark.range(1, rows + 1).selectExpr("id AS __rn", "id * 1.5D AS x0")
        order = [r[0] for r in d.select("__rn", F.xxhash64("__rn", F.lit(7)).alias("h")).orderBy("h", "__rn").collect()]
        made = selecting.shuffled(d, ["x0"], 7, rows)
        assert {r["__rn"]: r["s_x0"] for r in made.collect()} == {i: 1.5 * x for i, x in enumerate(order, 1)}
    assert made.count() == 5000 and not written
