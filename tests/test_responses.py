"""Graded response models against planted parameters and a plain likelihood."""

import numpy as np
import pytest

from loomwork.operators import responses

NODES = np.linspace(-6, 6, 61)


def plain_likelihood(rows, slopes, intercepts):
    """Person by person, node by node."""
    weights = np.exp(-NODES**2 / 2) / np.exp(-NODES**2 / 2).sum()
    total, persons = 0.0, {}
    for p, j, v in rows:
        persons.setdefault(p, []).append((j, v))
    for own in persons.values():
        like = weights.copy()
        for j, v in own:
            up = lambda k: 1.0 if k == 0 else 0.0 if k > len(intercepts[j]) else 1 / (1 + np.exp(-(slopes[j] * NODES + intercepts[j][k - 1])))  # noqa: B023, E731
            like = like * (up(v) - up(v + 1))
        total += np.log(like.sum())
    return total


def planted(n, slopes, intercepts, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for p, theta in enumerate(rng.normal(0, 1, n)):
        for j, (a, d) in enumerate(zip(slopes, intercepts)):
            if rng.random() < 0.95:
                rows.append((p, j, int((rng.random() < 1 / (1 + np.exp(-(a * theta + np.array(d))))).sum())))  # one draw against all levels
    return rows


def test_recovers_planted_parameters(spark):
    slopes, intercepts = [1.5, 0.8, 2.0, 1.2, 1.0], [[1.0, -0.5], [0.3], [1.5, 0.0, -1.5], [0.0], [-1.0]]
    rows = planted(3000, slopes, intercepts, 2)
    d = spark.createDataFrame(rows + [(None, 0, 1), (1, None, 1), (1, 0, None), (5, 9, 1)], "p long, j int, v int")  # item 9 has one level
    fit = responses.graded_responses(d, "p", "j", "v", tolerance=2e-3)
    assert fit.items == [0, 1, 2, 3, 4] and [len(x) for x in fit.intercepts] == [2, 1, 3, 1, 1]
    assert fit.slopes == pytest.approx(slopes, abs=0.3)
    assert np.concatenate(fit.intercepts) == pytest.approx(np.concatenate(intercepts), abs=0.25)
    assert all(b >= a - 1e-6 for a, b in zip(fit.rounds, fit.rounds[1:]))
    last = plain_likelihood(rows, fit.slopes, fit.intercepts)
    assert last >= fit.rounds[-1] - 1e-6 and last == pytest.approx(fit.rounds[-1], abs=0.05)
    for j in range(5):  # no step of one parameter is better by more than what the tolerance leaves
        for e in (-0.1, 0.1):
            s = fit.slopes.copy()
            s[j] += e
            assert plain_likelihood(rows, s, fit.intercepts) < last
    found = {r["p"]: (r["ability"], r["se"]) for r in responses.abilities(d, fit, "p", "j", "v").collect()}
    own = [(j, v) for p, j, v in rows if p == 7]
    like = np.exp(-NODES**2 / 2)
    for j, v in own:
        s = np.concatenate([[np.ones(61)], 1 / (1 + np.exp(-(fit.slopes[j] * NODES + fit.intercepts[j][:, None]))), [np.zeros(61)]])
        like = like * (s[v] - s[v + 1])
    mean = (like @ NODES) / like.sum()
    assert found[7] == pytest.approx((mean, np.sqrt(like @ NODES**2 / like.sum() - mean**2)), abs=1e-9)
    assert len(found) == len({p for p, _, _ in rows})


def test_repeated_rows_and_errors(spark):
    d = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 1), (2, "b", 0), (3, "a", 0)], "p long, j string, v int")
    items, levels = responses._item_levels(d, "j", "v")
    assert (items, levels) == (["a", "b"], [[0, 1], [0, 1]])
    assert {r["person"]: r["pattern"] for r in responses.response_patterns(d, "p", "j", "v", items, levels).collect()} == {1: [1, 1], 2: [-1, 0], 3: [0, -1]}
    with pytest.raises(ValueError, match="two items"):
        responses.graded_responses(spark.createDataFrame([], d.schema), "p", "j", "v")
