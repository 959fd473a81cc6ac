"""Near-duplicate texts by shingle similarity against brute force."""

import math
import random

import numpy as np
from test_text_operators import docs, words

from loomwork.llm import near_texts, simhash


def shingles(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_components(texts, similarity=0.8):
    """The least index that each text reaches over links of Jaccard similarity; texts without words are one."""
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    linked = [[j for j in range(len(texts)) if (not a and not sets[j]) or (a and len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-12)] for a in sets]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(linked):
            m = min(least[j] for j in near)
            if m < least[i]:
                least[i], changed = m, True
    return least


def edited(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_links_equal_brute_force(spark):
    rng = random.Random(1)
    base = [words(rng, rng.randint(60, 400)) for _ in range(60)]
    texts = base + [edited(rng, t, share) for t in base[:40] for share in (0.004, 0.02, 0.08)] + [base[0].upper(), base[0], None, "", " \t ", "one two", "One TWO", "one two three", base[1] + " " + base[2]]
    got = {r["doc_id"]: r["component_id"] for r in near_texts.similar_texts(docs(spark, texts)).collect()}
    want = plain_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 30 < len(set(want)) < len(texts) - 40
    kept = near_texts.drop_similar(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == docs(spark, []).columns


def test_a_large_group_of_near_copies_is_one(spark, monkeypatch):
    monkeypatch.setattr(simhash.dealt_blocks, "__defaults__", (64,))
    rng = random.Random(2)
    base = words(rng, 300)
    texts = [edited(rng, base, 0.004) for _ in range(400)] + [words(rng, 200) for _ in range(100)]
    got = {r["doc_id"]: r["component_id"] for r in near_texts.similar_texts(docs(spark, texts)).collect()}
    assert [got[i] for i in range(500)] == [0] * 400 + list(range(400, 500))


def test_partitions_find_what_they_promise():
    rng = np.random.default_rng(3)
    differ = math.acos(1.6 / 1.8) / math.pi
    for n in (1_000, 1_000_000, 30_000_000):
        p = rng.uniform(0.3, 0.7, near_texts.BITS)
        groups = near_texts.group_bits(10, np.diag(p * 10), 42)
        assert sorted(b for g in groups for b in g) == list(range(near_texts.BITS))
        _, thresholds = near_texts.thresholds_for_recall(n, p, groups, differ)
        flips = rng.random((4000, near_texts.BITS)) < differ
        found = np.zeros(4000, bool)
        for g, t in zip(groups, thresholds, strict=True):
            found |= flips[:, g].sum(1) <= 2 * t  # -1: never
        assert found.mean() > 0.985


def test_correlated_bits_share_a_group():
    both = np.full((near_texts.BITS, near_texts.BITS), 25.0)
    np.fill_diagonal(both, 50)
    for a, b in ((3, 400), (3, 77), (400, 77)):
        both[a, b] = both[b, a] = 48
    group = next(g for g in near_texts.group_bits(100, both, 32) if 3 in g)
    assert {77, 400} <= set(group)


def test_shortest_forest_equals_kruskal():
    rng = np.random.default_rng(4)
    a, b = rng.integers(40, size=300), rng.integers(40, size=300)
    keep = a != b
    a, b, apart = a[keep], b[keep], rng.integers(1, 20, size=keep.sum())
    root, total = list(range(40)), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in np.argsort(apart, kind="stable"):
        if find(a[k]) != find(b[k]):
            root[find(a[k])] = find(b[k])
            total += apart[k]
    kept = near_texts.shortest_forest(40, a, b, apart)
    assert apart[kept].sum() == total and len(kept) == 40 - len({find(x) for x in range(40)})
    assert len(near_texts.shortest_forest(3, a[:0], b[:0], apart[:0])) == 0


def test_edges(spark):
    assert near_texts.similar_texts(docs(spark, [])).count() == 0 and near_texts.drop_similar(docs(spark, [])).count() == 0
    rng = random.Random(5)
    t, long = words(rng, 50), words(rng, 60_000)
    d = docs(spark, [t, t, None, "", long, long + " end", t], ids=[None, 7, 8, 9, 10, 11, 7]).withColumnsRenamed({"lang": "node", "source": "code", "n_chars": "component_id"})
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in near_texts.similar_texts(d).collect())
    assert got == [("10", 10), ("11", 10), ("7", 7), ("7", 7), ("8", 8), ("9", 8), ("None", 7)]
    assert sorted(r["doc_id"] for r in near_texts.drop_similar(d).collect()) == [7, 8, 10]
    alone = docs(spark, ["a b", None], ids=[None, None])
    assert near_texts.drop_similar(alone).count() == 2
    assert [r["component_id"] for r in near_texts.similar_texts(docs(spark, ["one"])).collect()] == [0]


def test_families_around_the_threshold_lose_no_links(spark):
    """Families of near copies, most pairs of which are just above or below 0.8: components as from all pairs, but for what the partitions may miss."""
    rng = random.Random(6)
    texts = []
    for _ in range(24):
        base = words(rng, rng.randint(150, 300))
        texts += [edited(rng, base, rng.uniform(0.005, 0.02)) for _ in range(25)]
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for f in range(0, len(texts), 25) for i in range(f, f + 25) for j in range(i + 1, f + 25) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(linked) > 800
    got = {r["doc_id"]: r["component_id"] for r in near_texts.similar_texts(docs(spark, texts)).collect()}
    assert sum(got[i] != got[j] for i, j in linked) <= 0.01 * len(linked)
    want = plain_components(texts)
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 0.01 * len(texts)


def test_texts_with_one_id_are_kept_apart(spark):
    """The copy goes, the other text of its id stays; one row of each component."""
    rng = random.Random(7)
    x, y = words(rng, 80), words(rng, 80)
    rows, ids = [x, x, y, y + " end", y, None], [3, 5, 5, 5, None, 5]
    for drop in (near_texts.drop_similar, simhash.drop_near_duplicates):
        kept = [(r["doc_id"], r["text"]) for r in drop(docs(spark, rows, ids=ids)).collect()]
        assert (3, x) in kept and (5, None) in kept and len(kept) == len(set(kept))
        assert [t for _, t in kept].count(x) == 1 and 1 <= sum((t or "").startswith(y) for _, t in kept)
    assert len(near_texts.drop_similar(docs(spark, rows, ids=ids)).collect()) == 3


def test_common_shingles():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype("<u8")) for _ in range(40)]
    got = near_texts.common_shingles(sets, columns=64)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
