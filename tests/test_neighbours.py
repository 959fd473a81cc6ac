"""Exact nearest rows against all pairs, over trees of many leaves and hot points."""

import math
import random
import time

import pytest

from loomwork.operators import neighbours


def plain(rows, k, ties):
    out = []
    for i, *x in rows:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), o) for o, *y in rows if o != i)
        last = near[k - 1][0] if len(near) >= k else math.inf
        out += [(i, o, d) for d, o in (near if ties else near[:k]) if d <= last]
    return sorted(out)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("p", [1, 2, 5])
def test_equals_all_pairs(spark, monkeypatch, p, ties):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    monkeypatch.setattr(neighbours, "LAST_ROWS", 32)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = random.Random(p)
    spread = [(i, *[round(rng.uniform(0, 9), rng.choice([0, 1, 9])) for _ in range(p)]) for i in range(300)]
    dense = [(300 + i, *[rng.gauss(5, 0.001) for _ in range(p)]) for i in range(120)]
    equal = [(500 + i, *[1.5] * p) for i in range(12)]
    rows = spread + dense + equal
    d = spark.createDataFrame([*rows, (900, None, *[1.0] * (p - 1)), (901, float("nan"), *[1.0] * (p - 1))], "i long, " + ", ".join(f"c{j} double" for j in range(p)))
    got = sorted((r["id"], r["o"], r["d"]) for r in neighbours.nearest_rows(d, "i", [f"c{j}" for j in range(p)], 4, ties).collect())
    want = plain(rows, 4, ties)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(a[2] == pytest.approx(b[2], abs=1e-12) for a, b in zip(got, want))


def test_few_rows(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 3.0)], "i long, c double")
    assert sorted(map(tuple, neighbours.nearest_rows(d, "i", ["c"], 5).collect())) == [(1, 2, 3.0), (2, 1, 3.0)]
    assert neighbours.nearest_rows(d.limit(1), "i", ["c"], 5).count() == 0 and neighbours.nearest_rows(d.limit(0), "i", ["c"], 5, True).count() == 0


def test_many_columns_and_hot_places_cost_little_more(spark):
    """No join of all with all: eight columns, and half of all rows at one place or near it, take a few times what two even columns do."""
    rng = random.Random(3)
    even = [(i, *[rng.random() for _ in range(8)]) for i in range(12_000)]
    hot = [(i, *([0.5] * 8 if i % 4 == 0 else [0.5 + rng.gauss(0, 1e-6) for _ in range(8)] if i % 4 == 1 else row[1:])) for i, *_ in even for row in [even[i]]]
    names = [f"c{j}" for j in range(8)]
    schema = "i long, " + ", ".join(f"{c} double" for c in names)
    took = []
    for rows, columns in ((even, names[:2]), (even, names[:2]), (even, names), (hot, names[:2])):
        d = spark.createDataFrame(rows, schema)
        t = time.time()
        assert neighbours.nearest_rows(d, "i", columns, 5).count() == 60_000
        took.append(time.time() - t)
    assert max(took[2:]) < 4 * took[1] + 5, took
