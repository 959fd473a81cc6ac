"""Operators on small fixtures with values worked out by hand, and their errors."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loomwork.functions import special
from loomwork.operators import attribution, charts, cleaning, fuzzy, graph, inference, intervals, models, outliers, places, profiling, sentiment, statistics, timeseries
from loomwork.sources import files, samples
from loomwork.streaming import journeys


def day(m, d, y=2023):
    return dt.date(y, m, d)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---- intervals ----

SPANS = [(day(1, 2), day(1, 6), "A"), (day(1, 3), day(1, 7), "A"), (day(1, 5), day(1, 8), "B"), (day(1, 3), day(1, 4), "C")]


def test_daily_counts(spark):
    d = spark.createDataFrame(SPANS[:3], "start date, end date, g string")
    assert [n for _, n in rows(intervals.daily_counts(d, "start", "end"), "start", "n")] == [1, 2, 2, 3, 3, 2, 1]


def test_daily_counts_grouped(spark):
    d = spark.createDataFrame(SPANS, "start date, end date, g string")
    got = rows(intervals.daily_counts(d, "start", "end", "g"), "g", "start", "n")
    assert {g: [n for k, _, n in got if k == g] for g in "ABC"} == {"A": [1, 2, 2, 2, 2, 1], "B": [1] * 4, "C": [1] * 2}


def test_daily_counts_null_group_and_bad_spans(spark):
    d = spark.createDataFrame([(day(1, 1), day(1, 3), "A"), (day(1, 2), day(1, 4), None)], "start date, end date, g string")
    assert intervals.daily_counts(d, "start", "end", "g").where("g is null").count() == 3
    bad = spark.createDataFrame([(day(1, 2), day(1, 1))], "start date, end date")
    with pytest.raises(Exception, match="start dates must be"):
        intervals.daily_counts(bad, "start", "end").collect()
    with pytest.raises(ValueError, match="missing"):
        intervals.daily_counts(bad, "start", "stop")


def test_daily_summary_on_a_common_calendar(spark):
    d = spark.createDataFrame([("A", day(1, 2), day(1, 4), 9.0), ("B", day(1, 6), day(1, 6), 5.0)], "g string, start date, end date, v double")
    got = rows(intervals.daily_summary(d, "start", "end", "v", "g"), "g", "day", "value")
    assert [v for g, _, v in got if g == "A"] == [9, 9, 9, 0, 0] and [v for g, _, v in got if g == "B"] == [0, 0, 0, 0, 5]


# ---- series ----


def test_adstock(spark):
    assert timeseries.adstock_weights(3, 0.5) == pytest.approx([4 / 7, 2 / 7, 1 / 7])
    d = spark.createDataFrame([(t, float(t)) for t in range(1, 11)], "t int, x double")
    got = [v for _, v in rows(timeseries.adstock(d, "t", "x", 3, 0.5), "t", "adstock")]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([t - 10 / 7 for t in range(3, 11)])
    with pytest.raises(ValueError, match="lag"):
        timeseries.adstock_weights(0, 0.5)
    with pytest.raises(ValueError, match="decay"):
        timeseries.adstock_weights(2, 1.5)


def test_brown_smoothing(spark):
    d = spark.createDataFrame(list(enumerate([12.0, 15.0, 14.0, 16.0, 19.0, 20.0, 22.0, 25.0, 24.0, 23.0])), "t int, p double")
    got = {round(r["alpha"], 2): r for r in timeseries.brown_smoothing(d, "t", "p", [0.15, 0.2, 0.25, 0.3, 0.35], k=3, ahead=2).collect()}
    assert got[0.25]["sse"] == pytest.approx(35.03599, abs=1e-4) and got[0.25]["best"]


def test_hampel_repairs_a_spike(spark):
    d = spark.createDataFrame([(i, 100.0 if i == 7 else float(i % 3)) for i in range(15)], "t int, x double")
    got = dict(rows(timeseries.hampel(d, "t", "x"), "t", "repaired"))
    assert got[7] < 3 and all(got[i] == i % 3 for i in range(15) if i != 7)


def test_bucketed_series_errors(spark):
    d = spark.createDataFrame([(day(1, 1), 1.0)], "d date, v double")
    with pytest.raises(ValueError, match="unit"):
        timeseries.bucketed_series(d, "d", "v", "hour")
    assert rows(timeseries.bucketed_series(d, "d", "v", "day", 5), "bar", "line") == [(1.0, None)]


# ---- attribution ----


@pytest.fixture
def journey(spark):
    t = dt.datetime(2024, 1, 1)
    data = [("c1", "A", 0), ("c1", "B", 0), ("c1", "C", 1), ("c2", "A", 1), ("c3", "B", 1), ("c3", "C", 1)]
    return spark.createDataFrame([(c, p, v, t + dt.timedelta(hours=i)) for i, (c, p, v) in enumerate(data)], "customer_id string, touchpoint string, conversion int, timestamp timestamp")


def test_attribution(journey):
    got = attribution.analyse(journey)
    weights = {m: dict(rows(w, "touchpoint", "weight")) for m, w in got.items()}
    assert weights["linear"] == {"A": 0.25, "B": 0.25, "C": 0.5}
    assert weights["first_touch"] == {"A": 0.5, "B": 0.5}
    assert weights["last_touch"] == pytest.approx({"A": 1 / 3, "C": 2 / 3})
    assert weights["position_based"] == pytest.approx({"A": 1 / 2.2, "B": 0.4 / 2.2, "C": 0.8 / 2.2})
    assert all(sum(w.values()) == pytest.approx(1) for w in weights.values())
    joined = {r["touchpoint"]: r for r in attribution.joined_weights(journey, got).collect()}
    assert joined["C"]["weight_first_touch"] == 0


def test_attribution_errors(journey):
    with pytest.raises(ValueError, match="unknown"):
        attribution.analyse(journey, ["best"])
    with pytest.raises(ValueError, match="missing"):
        attribution.prepare(journey.drop("conversion"))
    with pytest.raises(ValueError, match="exceed"):
        attribution.position_based(attribution.prepare(journey), 0.6, 0.6)
    assert attribution.rename_journey(journey.toDF("a", "b", "c", "d"), [1, "b"], ["customer_id", "touchpoint"]).columns[:2] == ["customer_id", "touchpoint"]


# ---- profiling and cleaning ----


def test_modes(spark):
    d = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (None,)], "x int")
    assert rows(profiling.modes(d, "x"), "mode", "n_modes", "freq") == [("2, 3", 2, 2)]


def test_numeric_stats_null_group(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, x double")
    got = {r["g"]: r for r in profiling.numeric_stats(d, ["x"], ["g"]).collect()}
    assert got[None]["mean"] == 2 and got[None]["mad"] == pytest.approx(1.4826) and got["a"]["mean"] is None


def test_weights(spark):
    d = spark.createDataFrame([(1.0, 6.0, "m", "x"), (2.0, 5.0, "f", "y"), (3.0, None, "f", "x")], "x double, y double, gender string, race string")
    got = cleaning.apply_weights(d, {"gender": {"m": 0.5, "f": 2.0}, "race": {"x": 1.2}}, ["x", "y"]).collect()
    assert [(r["x_total_weight"], r["y_weighted"]) for r in got] == [(0.6, pytest.approx(3.6)), (2.0, 10.0)]
    with pytest.raises(ValueError, match="no level"):
        cleaning.apply_weights(d, {"gender": {"q": 1.0}}, ["x"])


def test_categorical_and_types(spark):
    d = spark.createDataFrame([(1, "a", "u", "2024-01-01"), (2, "b", "u", "2024-01-02"), (3, "c", "v", "2024-01-03"), (4, "d", "v", "2024-01-04"), (5, "e", "v", "2024-01-05")], "i int, k string, g string, d string")
    assert dict(rows(cleaning.categorical_columns(d), "variable", "categorical")) == {"i": False, "k": False, "g": True, "d": False}
    assert cleaning.classify_columns(d)["d"] == "date" and cleaning.classify_columns(d)["i"] == "numeric"


def test_cleaning_pieces(spark):
    assert cleaning.clean_names(["My Col (x)", "a--b", "Z "]) == ["mycol_x", "a_b", "z"]
    d = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    assert [r["s"] for r in cleaning.safe_numeric(d, "s").collect()] == [1.0, None, None]
    c = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 3.0, "a")], "k double, v double, s string")
    assert cleaning.constant_columns(c) == ["k", "s"]
    assert cleaning.apply_scaler(c, cleaning.fit_scaler(c, ["k"]), ["k"]).agg(F.sum("k")).first()[0] == 0
    with pytest.raises(ValueError, match="scaling"):
        cleaning.fit_scaler(c, ["k"], "odd")
    assert cleaning.shared_columns({"a": c, "b": d, "c": c.select("k")}) == [("a", "b", "s"), ("a", "c", "k")]
    assert cleaning.one_hot(c, "s", full_rank=True).columns == ["k", "v"]


def test_balanced_sample(spark):
    d = spark.createDataFrame([(i, float(i), float(i % 3), "rare" if i < 6 else "common") for i in range(30)], "id int, a double, b double, y string")
    out = cleaning.balanced_sample(d, "y", ["a", "b"], 200, 3)
    assert out.where("y = 'rare'").count() == 18
    made = out.where("id is null").agg(F.min("a"), F.max("a")).first()
    assert made[0] >= 0 and made[1] <= 5


# ---- outliers ----


@pytest.mark.parametrize(
    ("method", "values", "flagged"),
    [("z", [10.0] * 10 + [100.0], {100.0}), ("tukey", [1.0, 2.0, 3.0, 4.0, 50.0], {50.0}), ("mad", [5.0] * 4 + [20.0], {20.0}), ("modified_z", [1.0] * 4 + [10.0], {10.0}), ("z", [3.0, 3.0], set()), ("grubbs", [10.0, 10.1, 9.9, 10.2, 9.8, 30.0], {30.0})],
)
def test_outlier_flags(spark, method, values, flagged):
    d = spark.createDataFrame([(v,) for v in values], "x double")
    assert {r["x"] for r in outliers.METHODS[method](d, "x").collect() if r["outlier"]} == flagged


def test_grubbs_limit_and_short_input(spark):
    t = special.t_quantile(1 - 0.05 / 20, 8)
    assert outliers.grubbs_limit(10) == pytest.approx(9 / math.sqrt(10) * math.sqrt(t * t / (8 + t * t)))
    assert outliers.grubbs_flags(spark.createDataFrame([(1.0,), (9.0,)], "x double"), "x").where("outlier is null").count() == 2


def test_noise_keeps_unknown_points(spark):
    d = spark.createDataFrame([(i, 0.1 * i, 0.0) for i in range(6)] + [(9, 50.0, 0.0), (10, None, 1.0)], "id int, x double, y double")
    assert dict(rows(outliers.noise_flags(d, "id", ["x", "y"], 0.5, 3), "id", "outlier")) == {**dict.fromkeys(range(6), 0), 9: 1, 10: None}


# ---- texts ----


def test_fuzzy_distances(spark):
    q = spark.createDataFrame([("apple",)], "q string")
    c = spark.createDataFrame([(w,) for w in ("apple", "apples", "banana", "pineapple", "aple", "appla", "papple", None)], "c string")
    got = fuzzy.fuzzy_match(q, c, "q", "c", thresholds={"jaro": 0.4}).collect()
    at = {(r["method"], r["candidate"]): r["distance"] for r in got}
    assert at["levenshtein", "aple"] == 1 and at["damerau", "apples"] == 1 and ("levenshtein", "banana") not in at
    assert {k: round(1 - v, 4) for (m, k), v in at.items() if m == "jaro" and k in ("apples", "banana", "pineapple", "aple")} == {"apples": 0.9444, "banana": 0.4556, "pineapple": 0.5333, "aple": 0.9333}
    assert {k for m, k in at if m == "hamming"} == {"apple", "appla"}
    assert at["lcs", "appla"] == 2 and at["lcs", "apple"] == 0
    assert fuzzy._damerau("ca", "abc") == 2
    assert fuzzy.fuzzy_match(q, c, "q", "c", ["levenshtein"], top=1).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        fuzzy.fuzzy_match(q, c, "q", "c", ["soundex"])


def test_normalise(spark):
    d = spark.createDataFrame([("Mr.  Foo-Bar Ltd",)], "t string")
    assert d.select(fuzzy.normalise(F.col("t"), prefix="Mr", suffix="Ltd")).first()[0] == "foobar"


def test_sentiment(spark):
    d = spark.createDataFrame([(1, "Good, GREAT day"), (2, "not good, very bad"), (3, ""), (4, None)], "id int, t string")
    assert dict(rows(sentiment.sentiment_scores(d, "id", "t"), "id", "score")) == {1: 2.0, 2: 0.0, 3: None, 4: None}
    assert dict(rows(sentiment.negated_sentiment(d, "id", "t"), "id", "score")) == {1: 2.0, 2: -3.0, 3: 0.0, 4: 0.0}
    assert d.select(sentiment.label(F.lit(5.0), 5.0)).first()[0] == "neutral"
    wide = spark.createDataFrame([("a", 6.0, -2.0), ("b", 6.0, -2.0)], "item string, x double, y double")
    got = dict(rows(sentiment.sentiment_summary(wide, {"x": "afinn", "y": "bing"}, "item"), "method", "label"))
    assert got == {"afinn": "positive", "bing": "negative"}


# ---- statistics ----


def test_special_functions():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert special.chi2_quantile(0.95, 2) == pytest.approx(5.991464547, abs=1e-8)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.f_cdf(4.0, 2, 10) == pytest.approx(1 - 1.8**-5)
    assert special.gamma_p(2.0, 10.0) == pytest.approx(1 - math.exp(-10) * 11)


def test_distributions_and_tests(spark):
    d = spark.createDataFrame([(float(v),) for v in [0] * 2 + [1] * 3 + [2] * 5 + [3] * 4 + [4] * 4 + [5] * 2], "x double")
    g = statistics.goodness_of_fit(d, "x", "poisson")
    assert g["df"] == 5 and 0 < g["p"] < 1
    assert statistics.best_distribution(d.withColumn("x", F.exp("x") + 0.1), "x")[0]["family"] in ("gamma", "log_normal", "exponential", "gaussian")
    t = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    assert statistics.two_sample_t(t, "v", "g")["t"] == pytest.approx(-3.674234614)
    assert statistics.kruskal_wallis(t, "v", "g").first()["h"] == pytest.approx(3.857142857)
    m = {r["g"]: r for r in statistics.group_means(t, "v", "g").collect()}
    assert m["a"]["high"] - m["a"]["mean"] == pytest.approx(special.t_quantile(0.975, 2) / math.sqrt(3))
    fit = statistics.least_squares(t.withColumn("x", F.when(F.col("g") == "b", 1.0).otherwise(0.0)), "v", ["x"])
    assert fit["coefficients"] == pytest.approx({"1": 2.0, "x": 3.0}) and fit["r2"] == pytest.approx(13.5 / 17.5)
    r = statistics.residual_summary(t.withColumn("x", F.when(F.col("g") == "b", 1.0).otherwise(0.0)), "v", ["x"], "v").first()
    assert r["mean"] == pytest.approx(0, abs=1e-9) and r["max"] == pytest.approx(1)


def test_statistics_have_no_row_caps(spark):
    n = 120_000
    d = spark.range(n).select((F.col("id") + 1000).cast("double").alias("x"))
    m = 1000 + (n - 1) / 2
    want = sum(x * math.log(m) - m - math.lgamma(x + 1) for x in range(1000, 1000 + n))
    fits = {f["family"]: f for f in statistics.best_distribution(d, "x")}
    assert fits["poisson"]["log_likelihood"] == pytest.approx(want, rel=1e-9)
    many = spark.range(1100).select(F.col("id").alias("g"), F.explode(F.array(F.col("id"), F.col("id") + 3)).alias("v"))
    t = inference.dunn_table(many, "v", "g")
    assert t.count() == 1100 * 1099 // 2 and t.where("group2 = 1099").count() == 1099
    with pytest.raises(ValueError, match="500000"):
        inference.dunn_pairs(many, "v", "g")
    few = many.where("g % 50 = 0").withColumn("g", F.nullif("g", F.lit(500)))
    got = inference.dunn_pairs(few, "v", "g")
    best, want = 1.0, {}
    for k, r in sorted(enumerate(sorted(got, key=lambda x: x["p"]), 1), reverse=True):
        best = min(best, r["p"] * len(got) / k)
        want[r["group1"], r["group2"]] = best
    assert {(r["group1"], r["group2"]): r["p_adjusted"] for r in got} == pytest.approx(want) and len(got) == 22 * 21 // 2


def test_group_means_of_any_number_of_sizes(spark, monkeypatch):
    monkeypatch.setattr(statistics, "t_quantile", lambda p, n: float(n))  # the true one for 10,001 sizes takes long
    d = spark.range(2, 10_104).select("id", F.explode(F.sequence(F.lit(1), F.col("id"))).alias("v"))
    got = statistics.group_means(d, "v", "id")
    assert got.columns == ["id", "n", "mean", "sd", "low", "high"]
    assert got.agg(F.count(F.lit(1)), F.count("low"), F.count("high")).first() == (10_102, 10_102, 10_102)


# ---- graph ----

EDGES = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "E"), ("E", "C"), ("E", "F"), ("E", "G"), ("G", None), ("A", "A"), ("B", "A")]


def test_graph(spark):
    e = graph.simple_edges(spark.createDataFrame(EDGES, "s string, t string"), "s", "t")
    assert e.count() == 8
    assert dict(rows(graph.degrees(e), "node", "degree")) == {"A": 2, "B": 2, "C": 4, "D": 2, "E": 4, "F": 1, "G": 1}
    assert sum(t for _, t in rows(graph.triangle_counts(e), "node", "triangles")) == 6
    assert graph.transitivity(e).first()[0] == pytest.approx(0.4)
    assert {c for _, c in rows(graph.components(e), "node", "component")} == {"A"}
    other = graph.simple_edges(spark.createDataFrame([("A", "B"), ("C", "B"), ("F", "E")], "s string, t string"), "s", "t")
    assert tuple(graph.overlap(e, other).first()) == (5, 3)
    assert dict(rows(graph.core_numbers(e), "node", "core")) == {"A": 2, "B": 2, "C": 2, "D": 2, "E": 2, "F": 1, "G": 1}
    far = dict(rows(graph.distances(e, spark.createDataFrame([("A",)], "node string")), "node", "distance"))
    assert far == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 2, "F": 3, "G": 3}


def test_graph_has_no_bounds_on_distance_and_core(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.closeness(chain, spark.createDataFrame([(0,)], "node long")).first()["closeness"] == pytest.approx(40 / sum(range(1, 41)))
    n = spark.range(1003)
    clique = n.select(F.col("id").alias("a")).join(n.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    tail = spark.createDataFrame([(0, 2000), (2000, 2001)], "a long, b long")
    got = dict(rows(graph.core_numbers(clique.union(tail)), "node", "core"))
    assert got == {**dict.fromkeys(range(1003), 1002), 2000: 1, 2001: 1}
    assert graph.core_numbers(tail.limit(0)).count() == 0


# ---- charts, models, files, streams ----


def test_percentages_sum_to_a_hundred(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", None), ("b", 9)], "g string, q int")
    got = charts.survey_frequencies(d, ["q"], ["no", "yes"], by="g").collect()
    assert {(r["g"], r["response"]): r["pct"] for r in got} == {("a", "no"): 50, ("a", "yes"): 50, ("b", "yes"): 100}
    assert sum(r["n"] for r in charts.level_percentages(d, "q", nulls=True).collect()) == 5


def test_numbers_and_dots(spark):
    d = spark.createDataFrame([(950.0,), (1500.0,), (2_000_000.0,), (-5000.0,)], "x double")
    assert [r[0] for r in d.select(charts.abbreviated(F.col("x"))).collect()] == ["950.0", "1.5K", "2.0M", "-5000.0"]
    dots = charts.dot_grid(spark.createDataFrame([("a", 1), ("a", 0)], "f string, v int"), "v", "f")
    assert dots.where("filled").count() == 50


def test_models(spark):
    d = spark.createDataFrame([(i, float(i % 17), float(i % 5), 3.0 * (i % 17) - (i % 5) + (i % 3) * 0.1) for i in range(400)], "id int, a double, b double, y double")
    train, test = models.split(d, "id")
    p = models.predictions(test, models.fit_models(train, "y", ["a", "b"], ["ols", "lasso"]), ["id", "y"])
    assert models.score(p.withColumn("prediction", models.combined(["p_ols", "p_lasso"])), "y") < 0.5
    assert models.score(p.withColumn("prediction", models.combined(["p_ols", "p_lasso"], "weighted", [1, 0])), "y") < 0.2
    assert models.soft_votes(p, ["p_ols", "p_lasso"]).where("vote is null").count() == 0
    with pytest.raises(ValueError, match="weight"):
        models.combined(["a"], "weighted")
    assert models.tweedie_grid(d.withColumn("y", F.col("y") + 10), "y", ["a", "b"], [1.5])[0][0] == 1.5
    s = {r["g"]: r for r in models.shrunken_rates(spark.createDataFrame([("x", 1, 2), ("y", 50, 100), ("z", 9, 10)], "g string, h int, n int"), "g", "h", "n").collect()}
    assert abs(s["x"]["shrunken"] - s["z"]["shrunken"]) < 0.4


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,y\n")
    (tmp_path / "b.tsv").write_text("id\tv\n2\tz\n3\tw\n")
    (tmp_path / "c.odd").write_text("?")
    frames = files.read_folder(spark, str(tmp_path))
    assert sorted(frames) == ["a.csv", "b.tsv"]
    joined = files.join_frames([f.drop("system_date", "original_file_name") for f in frames.values()], "id")
    assert joined.count() == 3 and set(joined.columns) == {"id", "v.x", "v.y"}
    assert files.register_views(frames) == ["a", "b"] and spark.table("a").count() == 2
    with pytest.raises(ValueError, match="no readable"):
        files.read_folder(spark, str(tmp_path), "odd$")
    with pytest.raises(ValueError, match="database"):
        files.database(spark, "oracle9", "t")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.txt").write_text("AREA|C|N\n1|01005|Foo\n|02|Bar\n")
    cross = files.area_crosswalk(spark, str(tmp_path / "z" / "x.txt"), {"AREA": "area", "C": "code", "N": "name"}, "code", "state", "area")
    assert rows(cross, "area", "state") == [("1", "01")]
    assert rows(files.areas_of(cross, ["foo"], ["code", "name"], "area"), "area") == [("1",)]


def test_stream_equals_table(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(t + dt.timedelta(minutes=7 * i), f"k{i % 3}", float(i)) for i in range(60)], "ts timestamp, k string, v double")
    e.write.parquet(f"{tmp_path}/e")
    stream = journeys.windowed_events(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e"), "ts", ["k"], "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    want = rows(journeys.windowed_events(e, "ts", ["k"], "v"), "start", "k", "n", "total")
    assert rows(spark.table("windowed"), "start", "k", "n", "total") == want
    assert journeys.sessions(e.where("k = 'k0'"), "ts", "k", "30 minutes").count() == 1


# ---- multivariate and resampling ----


def test_discriminants_box_and_factors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(3, size=600)
    x = rng.standard_normal((600, 3)) + np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0]])[y]
    d = spark.createDataFrame([(str(k), *map(float, v)) for k, v in zip(y, x, strict=True)], "y string, a double, b double, c double")
    axes = inference.discriminant_axes(d, "y", ["a", "b", "c"])
    assert axes.shape == (3, 2) and np.abs(axes[2]).max() < 0.15
    assert {"ld1", "ld2"} <= set(inference.discriminant_scores(d, "y", ["a", "b", "c"]).columns)
    assert inference.box_m(d, "y", ["a", "b", "c"])["p"] > 0.001
    wide = d.withColumn("a", F.when(F.col("y") == "1", F.col("a") * 5).otherwise(F.col("a")))
    assert inference.box_m(wide, "y", ["a", "b", "c"])["p"] < 1e-6
    f = rng.standard_normal((800, 2))
    items = np.hstack([f[:, :1] + 0.5 * rng.standard_normal((800, 3)), f[:, 1:] + 0.5 * rng.standard_normal((800, 3))])
    e = spark.createDataFrame([tuple(map(float, r)) for r in items], ", ".join(f"i{k} double" for k in range(6)))
    loads = np.abs(inference.factor_loadings(e, [f"i{k}" for k in range(6)], 2))
    assert (loads.max(1) > 0.75).all() and (loads.min(1) < 0.3).all()


def test_resampling_isolation_and_dunn(spark):
    d = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 10)) for i in range(400)], "id int, g string, x double")
    got = {r["g"]: r for r in inference.bootstrap_intervals(inference.bootstrap_means(d, "x", "g", "id", 100), "g").collect()}
    assert got["a"]["low"] < 5 < got["a"]["high"] and got["b"]["low"] < 4 < got["b"]["high"]
    far = d.union(spark.createDataFrame([(999, "a", 100.0), (1000, "a", None)], d.schema))
    s = dict(rows(inference.isolation_scores(far, ["x"], "id"), "id", "isolation_score"))
    assert s[1000] is None and s[999] == max(v for v in s.values() if v is not None)
    p = inference.dunn_pairs(spark.createDataFrame([(k, float(v)) for k, base in (("a", 0), ("b", 1), ("c", 50)) for v in range(base, base + 20)], "g string, v double"), "v", "g")
    assert [r["p_adjusted"] < 0.01 for r in p] == [False, True, True] and all(r["p_adjusted"] >= r["p"] * (1 - 1e-9) for r in p)


def test_places_and_people(spark):
    import numpy as np

    d = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 3.0, 4.0), (4, 1.0, 1.0), (5, 40.0, None), (6, 90.0, 90.0)], "id int, x double, y double")
    assert rows(places.nearest_points(d, "id", "x", "y", 5.0), "id", "neighbour") == [(1, 4), (2, 4), (3, 4), (4, 1), (6, None)]
    assert {tuple(p) for p in np.round(places.convex_hull(d, "x", "y"), 6)} == {(0, 0), (3, 0), (90, 90), (3, 4)}
    assert places.greatest_distance(d, "x", "y") == pytest.approx(90 * 2**0.5)
    p = samples.people(spark, 50, 3)
    assert p.collect() == samples.people(spark, 50, 3).repartition(3).orderBy("id").collect() and p.where("email rlike '^[a-z]+_[a-z]+@example'").count() == 50
