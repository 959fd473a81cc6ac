"""Crowded places: flags and neighbours equal brute force, and a crowd isn't compared with itself."""

import time

import numpy as np
import pytest

from loomwork.operators import outliers, places


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("least", [1, 4])
def test_noise_equals_brute_force(spark, dims, least, monkeypatch):
    monkeypatch.setattr(outliers, "CELL_ROWS", 7)
    r = np.random.default_rng(dims)
    x = np.concatenate([r.uniform(0, 12, size=(150, dims)), 3 + r.normal(size=(120, dims)) / 10, np.full((9, dims), 8.0), np.full((1, dims), -40.0)])
    columns = [f"x{i}" for i in range(dims)]
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, *[None] * dims), (901, *[float("nan")] * dims)], ", ".join(["id int", *[f"{c} double" for c in columns]]))
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.8 * 0.8
    dense = near.sum(axis=1) >= least
    want = {i: int(not (near[i] & dense).any()) for i in range(len(x))} | {900: None, 901: None}
    assert {r["id"]: r["outlier"] for r in outliers.noise_flags(d, "id", columns, 0.8, least).collect()} == want


def test_a_crowd_costs_no_pairs(spark):
    """60,000 points within one reach: 1.8 billion pairs, if they were compared."""
    d = spark.range(60_000).selectExpr("id", "rand(1) * 0.3 AS x", "rand(2) * 0.3 AS y")
    start = time.time()
    assert outliers.noise_flags(d, "id", ["x", "y"], 1.0, 5).where("outlier = 1").count() == 0
    assert time.time() - start < 30


def test_nearest_points_equal_brute_force(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.uniform(0, 100, size=(200, 2)), 50 + r.normal(size=(200, 2)) / 100, [[7.0, 7.0], [7.0, 7.0], [300.0, 300.0]]])
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(999, None, 1.0)], "id int, x double, y double")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    want = {i: (int(row.argmin()), pytest.approx(row.min())) if row.min() <= 6 else (None, None) for i, row in enumerate(far)}
    assert {r["id"]: (r["neighbour"], r["distance"]) for r in places.nearest_points(d, "id", "x", "y", 6.0).collect()} == want
    assert places.nearest_points(d.limit(0), "id", "x", "y", 6.0).count() == 0
