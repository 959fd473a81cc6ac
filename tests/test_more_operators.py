"""Preparation, tests, graph metrics, fuzzy prefixes, densities and model combinations against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import special
from loomwork.operators import charts, cleaning, fuzzy, graph, hypothesis, models, outliers, preparing, sentiment, statistics


def test_stratified_split_holds_in_each_level(spark):
    d = spark.createDataFrame([(i, random.Random(i).choice("aab") if i % 9 else None, float(i)) for i in range(900)], "id int, y string, x double")
    train, test = preparing.stratified_split(d, "y", "id", 0.7)
    assert train.count() + test.count() == 900 and not {r["id"] for r in train.collect()} & {r["id"] for r in test.collect()}
    n = {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
    assert all(abs(r["count"] - 0.7 * n[r["y"]]) <= 1.5 for r in train.groupBy("y").count().collect())
    a, b = preparing.stratified_split(d, "x", "id", 0.5)
    assert all(abs(a.where(f"x >= {k} and x < {k + 180}").count() - 90) <= 1 for k in range(0, 900, 180)) and b.count() == 900 - a.count()


def test_preparation_learns_from_training_rows_only(spark):
    rows = [(i, "yes" if i % 2 else "no", float(i % 2) * 5 + random.Random(i).random(), random.Random(-i).random() if i % 7 else None, ["u", "v", None][i % 3]) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, y string, a double, b double, f string")
    train, test, p = preparing.prepare(d, "y", "id", fill="median", scaling="robust")
    assert train.columns == test.columns == ["id", "y", "a", "b", "f.u", "f.v", "a_x_b"]
    assert train.where("b is null").count() == test.where("b is null").count() == 0
    same = p.apply(d.where("id = 7")).first()
    assert same in [*train.where("id = 7").collect(), *test.where("id = 7").collect()]
    chosen, _, q = preparing.prepare(d, "y", "id", select=1)
    assert chosen.columns in (["a", "id", "y"], ["a_x_b", "id", "y"])
    rows = preparing.tune_preparation(d, "y", "id", {"multiplier": [1.5], "scaling": ["standard", "minmax"]}, trees=5)
    assert len(rows) == 2 and rows[0]["score"] >= rows[1]["score"] > 0.9


def test_column_filters(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(1, rng.random(), "a" if i else "b", None) for i in range(100)], "k int, v double, s string, z double")
    got = {r["variable"]: (r["freq_ratio"], r["near_zero"]) for r in preparing.near_zero_variance(d, ["k", "v", "s", "z"]).collect()}
    assert got == {"k": (None, True), "v": (1.0, False), "s": (99.0, True), "z": (None, True)}
    x = [(rng.random(), rng.random()) for _ in range(200)]
    e = spark.createDataFrame([(a, a + 0.01 * b, b, a + b) for a, b in x], "a double, b double, c double, d double")
    assert len(preparing.correlated_columns(e, ["a", "b", "c", "d"], 0.89)) == 1 and preparing.correlated_columns(e, ["a", "c"], 0.89) == []
    assert cleaning.remove_duplicates(e.union(e)).count() == 200


def test_normality_equals_plain(spark):
    rng = np.random.default_rng(2)
    x = {"n": np.round(rng.normal(3, 2, 80), 1), "e": rng.exponential(1, 60), "c": np.ones(9), "two": np.array([1.0, 2.0])}
    d = spark.createDataFrame([(g, float(v)) for g, a in x.items() for v in a] + [("n", None)], "g string, x double")
    got = {r["g"]: r for r in hypothesis.normality(d, ["x"], "g").collect()}
    for g in ("n", "e"):
        a = np.sort(x[g])
        n = len(a)
        place = np.array([np.mean(np.flatnonzero(a == v)) + 1 for v in a])
        m = np.array([hypothesis.normal_quantile((p - 0.375) / (n + 0.25)) for p in place])
        assert got[g]["w"] == pytest.approx(np.corrcoef(a, m)[0, 1] ** 2, rel=1e-9) and got[g]["n"] == n
        f = np.array([special.normal_cdf((v - a.mean()) / a.std(ddof=1)) for v in a])
        i = np.arange(1, n + 1)
        assert got[g]["a2"] == pytest.approx(-n - np.mean((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))), rel=1e-6)
    assert got["n"]["p"] > 0.05 > got["e"]["p"] and got["c"]["w"] is None and got["two"]["w"] is None
    assert hypothesis.normal_quantile(0.975) == pytest.approx(1.959963984540054)


def test_means_and_bayes_factor(spark):
    # the sleep data: two treatments, known figures
    sleep = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0, 1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]
    d = spark.createDataFrame([(v, 1 + i // 10) for i, v in enumerate(sleep)], "extra double, g int")
    r = hypothesis.pairwise_t(d, "extra", "g").first()
    assert (r["t"], r["df"], r["p"]) == (pytest.approx(-1.8608, abs=1e-4), pytest.approx(17.776, abs=1e-3), pytest.approx(0.07939, abs=1e-5)) and r["p_adjusted"] == r["p"]
    w = hypothesis.welch_anova(d, "extra", "g").first()
    assert w["f"] == pytest.approx(r["t"] ** 2) and w["df2"] == pytest.approx(r["df"]) and w["p"] == pytest.approx(r["p"])
    assert hypothesis.bayes_factor(d, "extra", "g") == pytest.approx(1.265925, abs=1e-5)
    assert hypothesis.bayes_factor(d, "extra", "g", form="logbf") == pytest.approx(math.log(1.265925), abs=1e-5)
    with pytest.raises(ValueError, match="two groups"):
        hypothesis.bayes_factor(d.where("g = 1"), "extra", "g")
    with pytest.raises(ValueError, match="unknown"):
        hypothesis.bayes_factor(d.withColumn("extra", F.when(F.col("extra") > 0, F.col("extra"))), "extra", "g")


def test_roc_comparison_equals_plain(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(30) + 8 * y, rng.random() + 0.3 * y, y) for y in [rng.randrange(2) for _ in range(120)]]
    d = spark.createDataFrame([*rows, (None, 0.5, 1), (3, 0.5, None)], "a int, b double, y int")
    r = hypothesis.compare_roc(d, "a", "b", "y").first()
    pos, neg = [x for x in rows if x[2]], [x for x in rows if not x[2]]
    v = np.array([[[(p[k] > q[k]) + 0.5 * (p[k] == q[k]) for q in neg] for p in pos] for k in (0, 1)], float)
    auc = v.mean((1, 2))
    s = np.cov(v.mean(2)) / len(pos) + np.cov(v.mean(1)) / len(neg)
    assert (r["auc1"], r["auc2"]) == pytest.approx(tuple(auc)) and (r["se1"], r["se2"]) == pytest.approx((s[0, 0] ** 0.5, s[1, 1] ** 0.5))
    assert r["z"] == pytest.approx((auc[0] - auc[1]) / (s[0, 0] + s[1, 1] - 2 * s[0, 1]) ** 0.5) and 0 <= r["p"] <= 1


def test_resampled_rank_tests_equal_plain(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(25) + 3 * (i % 2)), i % 2) for i in range(90)]
    d = spark.createDataFrame(rows, "id int, x double, y int")
    got = {r["replicate"]: r for r in hypothesis.bootstrap_rank_tests(d, "x", "y", "id", 3).collect()}
    u = d.select("id", *[(F.pmod(F.xxhash64("id", F.lit(k), F.lit(0)), F.lit(1 << 30)) / (1 << 30)).alias(str(k)) for k in (1, 2, 3)]).collect()
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    for k in (1, 2, 3):
        weight = {r["id"]: int((r[str(k)] >= cuts).sum()) for r in u}
        a = [x for i, x, y in rows if y for _ in range(weight[i])]
        b = [x for i, x, y in rows if not y for _ in range(weight[i])]
        auc = np.mean([(p > q) + 0.5 * (p == q) for p in a for q in b])
        n0, n1, n = len(b), len(a), len(a) + len(b)
        ties = sum((a + b).count(v) ** 3 - (a + b).count(v) for v in set(a + b))
        z = max(abs(auc * n0 * n1 - n0 * n1 / 2) - 0.5, 0) / math.sqrt(n0 * n1 / 12 * (n + 1 - ties / (n * (n - 1))))
        assert got[k]["auc"] == pytest.approx(auc) and got[k]["p"] == pytest.approx(2 * (1 - special.normal_cdf(z)), abs=1e-12)
    f = hypothesis.bootstrap_figures(hypothesis.bootstrap_rank_tests(d, "x", "y", "id", 20)).first()
    assert f["auc_low"] < f["auc_high"] and f["lower_bound"] <= f["upper_bound"] and 0 <= f["proportion"] <= 1


def plain_paths(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def test_graph_metrics_equal_plain(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}) + [(30, 31)]
    d = spark.createDataFrame(edges, "a long, b long")
    nodes = sorted({x for e in edges for x in e})
    near = plain_paths(40, edges)

    def paths(s):
        dist, count, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in sorted(near[v]):
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        return dist, count

    reach = {v: paths(v) for v in nodes}
    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        if t in reach[s][0]:
            for v in nodes:
                if v not in (s, t) and v in reach[s][0] and reach[s][0][v] + reach[v][0].get(t, 1e9) == reach[s][0][t]:
                    want[v] += reach[s][1][v] * reach[v][1][t] / reach[s][1][t]
    everyone = spark.createDataFrame([(v,) for v in nodes], "node long")
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(d, everyone).collect()} == pytest.approx(want)
    a = np.zeros((40, 40))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    got = {r["node"]: r["centrality"] for r in graph.eigenvector_centrality(d.where("a != 30")).collect()}
    values, vectors = np.linalg.eigh(a[:25, :25])
    lead = np.abs(vectors[:, -1]) / np.abs(vectors[:, -1]).max()
    assert all(got[v] == pytest.approx(lead[v], abs=1e-6) for v in got)
    core = {r["node"]: r["core"] for r in graph.core_numbers(d).collect()}
    left, plain, k = {v: set(near[v]) for v in nodes}, {}, 0
    while left:
        v = min(left, key=lambda v: len(left[v]))
        k = max(k, len(left[v]))
        plain[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    assert core == plain
    s = graph.small_world(d, everyone).first()
    far = [x for v in nodes for x in reach[v][0].values() if x]
    assert s["mean_distance"] == pytest.approx(np.mean(far)) and s["small_world"] > 0
    none = d.limit(0)
    assert graph.core_numbers(none).count() == graph.betweenness(none, everyone.limit(0)).count() == graph.eigenvector_centrality(none).count() == 0


@pytest.mark.parametrize("method", ["jaro", "cosine", "levenshtein", "damerau", "lcs", "hamming"])
@pytest.mark.parametrize("strict", [True, False])
def test_fuzzy_pairs_equal_all_pairs(spark, method, strict):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcde é-") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["martha", "marhta", "dixon", "dicksonx", "aaaa", "aaa"]
    names = sorted({*names, *[n[::-1] for n in names[:20]], *[n[:-1] for n in names[:20]]})
    limit = {"jaro": 0.9 if strict else 0.6, "cosine": 0.1 if strict else 0.5}.get(method, 1 if strict else 4)
    d = spark.createDataFrame([(n,) for n in names], "t string")
    got = {(r["query"], r["candidate"]): r["distance"] for r in fuzzy.fuzzy_match(d, d, "t", "t", [method], {method: limit}).collect()}

    def distance(a, b):
        if method == "jaro":
            return 1 - fuzzy._jaro(a, b) if a and b else 9.0
        if method == "cosine":
            ca, cb = ({c: x.count(c) for c in x} for x in (a, b))
            if not a or not b:
                return 9.0
            return 1 - sum(n * cb.get(c, 0) for c, n in ca.items()) / math.sqrt(sum(n * n for n in ca.values()) * sum(n * n for n in cb.values()))
        if method == "hamming":
            return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99
        if method == "lcs":
            return len(a) + len(b) - 2 * fuzzy._common_subsequence(a, b)
        if method == "damerau":
            return fuzzy._damerau(a, b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    top = 1 - limit if method == "jaro" else limit
    want = {(a, b): distance(a, b) for a in names for b in names if distance(a, b) <= top + 1e-12}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_densities_and_random_numbers(spark):
    d = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (2.5,), (None,)], "x double")
    at = lambda family, p: [r["density"] for r in statistics.density(d, "x", family, p).collect()]
    assert at("gaussian", [0, 1]) == pytest.approx([math.exp(-x * x / 2) / math.sqrt(2 * math.pi) for x in (-1, 0, 2, 2.5)])
    assert at("poisson", [3]) == pytest.approx([0, math.exp(-3), math.exp(-3) * 4.5, 0])
    assert at("binomial", [4, 0.25]) == pytest.approx([0, 0.75**4, 6 * 0.25**2 * 0.75**2, 0])
    assert at("exponential", [2]) == pytest.approx([0, 2, 2 * math.exp(-4), 2 * math.exp(-5)])
    assert at("geometric", [1.0]) == pytest.approx([0, 1, 0, 0]) and at("geometric", [0.5]) == pytest.approx([0, 0.5, 0.125, 0])
    assert at("gamma", [2, 1]) == pytest.approx([0, 0, 2 * math.exp(-2), 2.5 * math.exp(-2.5)])
    assert at("log_normal", [0, 1])[:2] == [0, 0]
    for family, p in (("gaussian", [0, 0]), ("odd", [1]), ("geometric", [0])):
        with pytest.raises(ValueError, match="no such"):
            statistics.density(d, "x", family, p)
    means = {"gaussian": ([5, 2], 5), "poisson": ([4], 4), "binomial": ([10, 0.3], 3), "exponential": ([0.5], 2), "geometric": ([0.25], 3), "gamma": ([3, 2], 1.5), "log_normal": ([0, 0.1], math.exp(0.005))}
    for family, (p, mean) in means.items():
        a = statistics.random_numbers(spark, family, 5000, p, 1, block=999)
        s = a.agg(F.count(F.lit(1)), F.avg("value"), F.count_distinct("id")).first()
        assert s[0] == s[2] == 5000 and s[1] == pytest.approx(mean, rel=0.06)
    assert a.orderBy("id").limit(5).collect() == statistics.random_numbers(spark, family, 2000, p, 1, block=999).orderBy("id").limit(5).collect()


def test_model_combinations(spark):
    rng = random.Random(7)
    d = spark.createDataFrame([(i, a, b, 1 + 2 * a - b + 0.1 * rng.gauss(0, 1)) for i, a, b in ((i, rng.random(), rng.random()) for i in range(240))], "id int, a double, b double, y double")
    w = models.inverse_error_weights(d.withColumn("p", F.col("y") + 1).withColumn("q", F.col("y") + 3).withColumn("n", F.lit(None).cast("double")), ["p", "q", "n"], "y")
    assert w == pytest.approx({"p": 0.75, "q": 0.25, "n": 0.0}) and models.inverse_error_weights(d, ["y"], "y") == {"y": 1.0}
    train, test = models.split(d, "id")
    out = models.stacked_predictions(test, models.stacked(train, "y", ["a", "b"], "id", ["ols", "ridge"]), ["id", "y"])
    e = out.agg(F.sqrt(F.avg((F.col("p_stacked") - F.col("y")) ** 2))).first()[0]
    assert e < 0.25 and out.columns == ["id", "y", "p_ols", "p_ridge", "p_stacked"]
    chosen = {r["feature"]: r["selected"] for r in models.forest_selection(d.withColumn("z", F.lit(0.0)), "y", ["a", "b", "z"], keep=1, trees=10).collect()}
    assert chosen == {"a": True, "b": False, "z": False}
    t = d.withColumn("c", F.exp("a"))
    assert 0 <= models.tweedie_error(t, "c", ["a"], "id", 2, (1.5,)) < 0.05


def test_outlier_dispatch(spark):
    d = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(60)] + [(60, 500.0, 500.0), (61, None, 1.0)], "id int, x double, y double")
    out = {r["id"]: r.asDict() for r in outliers.detect_outliers(d, "id", ["x", "y"], eps=2.0).collect()}
    flags = [c for c in out[60] if c.endswith("_outlier")]
    assert len(flags) == 2 * 5 + 6 and len(out) == 62
    assert all(out[60][f] == 1 for f in flags) and all(out[61][f] is None for f in flags if f.startswith(("x_", "multivariate_m")))
    assert sum(out[i]["x_tukey_outlier"] for i in range(60)) == 0
    with pytest.raises(ValueError, match="methods"):
        outliers.detect_outliers(d, "id", ["x"], ["odd"])


def test_chart_helpers_and_shifters(spark):
    d = spark.createDataFrame([("a_b cD",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(charts.title_case(F.col("t"))).collect()] == ["A B CD", "", None]
    t = spark.createDataFrame([(1, "not very good"), (2, "Never not BAD, very"), (3, "so so, happy"), (4, "knot good")], "id int, t string")
    assert {r["id"]: r["score"] for r in sentiment.negated_sentiment(t, "id", "t").collect()} == {1: -2.0, 2: -1.0, 3: 4.0, 4: 1.0}
    words = spark.createDataFrame([("knot", 2.0), ("good", 1.0), ("good", 3.0)], "token string, value double")
    assert {r["id"]: r["score"] for r in sentiment.sentiment_scores(t, "id", "t", words).collect()} == {1: 2.0, 2: 0.0, 3: 0.0, 4: 4.0}
