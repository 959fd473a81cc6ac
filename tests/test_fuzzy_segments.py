"""Texts within a few edits share a rare segment: no pair is lost, and few others are met."""

import random

import pytest

from loomwork.operators import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


DISTANCES = {
    "levenshtein": edits,
    "damerau": fuzzy._damerau,
    "lcs": lambda a, b: len(a) + len(b) - 2 * fuzzy._common_subsequence(a, b),
    "hamming": lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99,
}


def changed(rng, text):
    """One edit; now and then two neighbours change places around an inserted letter."""
    i = rng.randint(0, max(len(text) - 2, 0))
    return rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abé") + text[i:], text[:i] + text[i + 1 : i + 2] + text[i : i + 1] + text[i + 2 :], text[:i] + text[i + 1 : i + 2] + "x" + text[i : i + 1] + text[i + 2 :]])


@pytest.mark.parametrize("method", list(DISTANCES))
@pytest.mark.parametrize("t", [0, 1, 2, 3])
def test_no_pair_is_lost(spark, method, t, monkeypatch):
    monkeypatch.setattr(fuzzy, "HOT", 4)
    rng = random.Random(t)
    texts = ["", "a", "ab", "ba", "number " * 20] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 14))) for _ in range(30)] + [f"Number#0000{i}" for i in range(20)]
    for x in list(texts):
        y = x
        for _ in range(rng.randint(1, 3)):
            y = changed(rng, y)
        texts.append(y)
    texts = sorted(set(texts))
    d = spark.createDataFrame([(x,) for x in texts] + [(None,)], "t string")
    got = fuzzy.fuzzy_match(d, d, "t", "t", [method], {method: t}).collect()
    want = {(a, b): DISTANCES[method](a, b) for a in texts for b in texts if abs(len(a) - len(b)) <= t and DISTANCES[method](a, b) <= t}
    assert len(got) == len(want)
    assert {(r["query"], r["candidate"]): r["distance"] for r in got} == want


def test_few_pairs_are_met(spark):
    """20,000 names of equal length: met by segments are a thousandth of all pairs at most."""
    rng = random.Random(2)
    names = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(20_000)}
    d = spark.createDataFrame([(n,) for n in names], "query string")
    c = d.withColumnRenamed("query", "candidate")
    assert fuzzy._segment_pairs(d, c, "levenshtein", 2).count() < len(names) ** 2 / 1000
