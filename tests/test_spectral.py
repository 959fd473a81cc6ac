"""Subgraph centrality against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import graph, spectral


def dense(pairs, n):
    a = np.zeros((n, n))
    for x, y in pairs:
        if x != y:
            a[x, y] = a[y, x] = 1
    values, vectors = np.linalg.eigh(a)
    return values, (vectors**2) @ np.exp(values)


def test_equals_dense(spark):
    rng = np.random.default_rng(1)
    n = 500
    hub = [(0, int(v)) for v in rng.choice(np.arange(1, n), 60, replace=False)]
    pairs = hub + [(int(a), int(b)) for a, b in rng.integers(0, n - 1, (700, 2))] + [(3, 3)]  # the last node stays alone
    values, want = dense(pairs, n)
    e = graph.simple_edges(spark.createDataFrame(pairs, "x int, y int"), "x", "y")
    bound = spectral.radius_bound(e)
    assert values.max() <= bound + 1e-9 < 1.5 * values.max()
    sources = spark.createDataFrame([(i,) for i in (*range(0, n, 50), n - 1, None)], "node int")
    got = {r["node"]: r["centrality"] for r in spectral.subgraph_centrality(e, sources).collect()}
    assert got == pytest.approx({i: want[i] for i in (*range(0, n, 50), n - 1)}, rel=1e-9) and got[n - 1] == 1
    est = spectral.estimated_subgraph_centrality(e, 64).collect()
    assert {r["node"] for r in est} == {i for p in pairs for i in p if p[0] != p[1]}
    inside = np.mean([r["low"] <= want[r["node"]] <= r["high"] for r in est])
    assert inside > 0.88 and all(0.4 < r["centrality"] / want[r["node"]] < 2 for r in est)


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert spectral.radius_bound(none) == 0 and spectral.estimated_subgraph_centrality(none, 4).count() == 0
    assert [tuple(r) for r in spectral.subgraph_centrality(none, spark.createDataFrame([(1,)], "node int")).collect()] == [(1, 1.0)]
    with pytest.raises(ValueError, match="too large"):
        spectral._terms(1000.0)


def test_edges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(b):
        seen.add(1)
        return b

    pairs = [(1, 2), (2, 3), (3, 4), (1, 3), (5, 6)]
    e = spark.createDataFrame(pairs, "a int, b int").withColumn("b", F.udf(noted, "int").asNondeterministic()("b"))
    assert spectral.subgraph_centrality(e, spark.createDataFrame([(1,)], "node int")).count() == 1
    assert seen.value == len(pairs)
    assert spectral.estimated_subgraph_centrality(e, 4).count() == 6
    assert seen.value == 2 * len(pairs)


def test_rounds_of_many_nodes_are_dealt_by_their_number(spark, monkeypatch):
    e = spark.createDataFrame([(i, i + 1) for i in range(100)], "a int, b int")
    want = {r["node"]: tuple(r)[1:] for r in spectral.estimated_subgraph_centrality(e, 2).collect()}
    plans = []
    monkeypatch.setattr(spectral, "stored", lambda d, f=spectral.stored: plans.append(d._jdf.queryExecution().executedPlan().toString()) or f(d))
    monkeypatch.setattr(spectral, "TASK_NODES", 20)
    got = {r["node"]: tuple(r)[1:] for r in spectral.estimated_subgraph_centrality(e, 2).collect()}
    rounds = [p for p in plans if "sum(x0#" in p]
    assert len(rounds) >= 3 and all(f"hashpartitioning({end}#" in p and ", 6)" in p and ", 3)" not in p for p in rounds for end in ("a", "b", "node"))
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want)
