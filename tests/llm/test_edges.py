"""Classifiers against plain dense fits, and the edge cases of every operator and of the pipeline: long texts, ties, repeats, clashing names, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models_and_vectors import clusters, texts_with_grades
from test_text_operators import docs, words

import corpus_pipeline
from loomwork.llm import hashed_text, line_dedup, mih, packing, pq_dedup, quality, simhash, toxicity
from loomwork.llm.queries import tokenizer_file


def dense(texts):
    slots, starts = hashed_text.text_slots(texts)
    used, local = np.unique(slots, return_inverse=True)
    x = np.zeros((len(texts), len(used)))
    np.add.at(x, (np.repeat(np.arange(len(texts)), np.diff(starts)), local), 1.0)
    return x


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def test_ordinal_fit_agrees_with_a_dense_one(spark):
    rows = texts_with_grades(random.Random(11), 700)
    grade = np.array([g for _, _, g, _ in rows])
    x = dense([t for _, t, _, _ in rows])
    x /= np.sqrt(np.array([len(set(t.split())) for _, t, _, _ in rows]) + 1)[:, None]
    train, k = np.arange(700) < 450, 5
    v = np.concatenate([np.zeros(x.shape[1]), [-2.0, -0.7, 0.7, 2.0]])
    first, second = np.zeros_like(v), np.zeros_like(v)
    for t in range(1, 1001):  # Adam's steps on the whole likelihood, with a little shrinkage
        w, cut = v[:-4], np.maximum.accumulate(v[-4:] + 1e-6 * np.arange(4))
        s = x[train] @ w
        ends = np.hstack([-np.inf, cut, np.inf])
        hi, lo = sigmoid(ends[grade[train] + 1] - s), sigmoid(ends[grade[train]] - s)
        gap = np.maximum(hi - lo, 1e-9)
        move = np.zeros(k + 1)
        np.add.at(move, grade[train] + 1, -hi * (1 - hi) / gap)
        np.add.at(move, grade[train], lo * (1 - lo) / gap)
        g = np.concatenate([x[train].T @ (1 - hi - lo) + w, move[1:-1]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        v = v - 0.02 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    w, cut = v[:-4], v[-4:]
    upto = np.hstack([sigmoid(cut[None] - (x @ w)[:, None]), np.ones((700, 1))])
    expected = np.diff(upto, axis=1, prepend=0.0) @ np.arange(k)
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    r = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grade) if train[i]], "doc_id long, grade int")
    got = {x["doc_id"]: x for x in quality.grade_documents(d, r, keep_grade=3).collect()}
    held = np.flatnonzero(~train)
    ours = np.array([got[i]["expected_grade"] for i in held])
    assert np.corrcoef(ours, expected[held])[0, 1] > 0.95
    assert np.mean(np.abs(ours - grade[held])) < 0.5 and np.mean(np.abs(expected[held] - grade[held])) < 0.1
    tail = (np.diff(upto, axis=1, prepend=0.0)[:, 3:]).sum(1)
    assert np.mean([got[i]["kept"] == (tail[i] >= 0.5) for i in held]) > 0.93


def test_chain_agrees_with_a_dense_one(spark):
    rows = texts_with_grades(random.Random(12), 700)
    y = np.array([[g < 1, t] for _, _, g, t in rows], float)
    x, train = dense([t for _, t, _, _ in rows]), np.arange(700) < 450

    def fit(a, b):
        w, c = np.zeros(a.shape[1]), 0.0
        for _ in range(300):
            e = sigmoid(a @ w + c) - b
            w, c = w - 0.05 * (a.T @ e / len(b) * 10 + 0.01 * w), c - 0.05 * e.mean() * 10
        return w, c

    folds = np.arange(450) % 3
    earlier = np.zeros((700, 1))
    w, c = fit(x[train], y[train, 0])
    earlier[~train, 0] = sigmoid(x[~train] @ w + c)
    for f in range(3):
        inside = np.flatnonzero(train)[folds == f]
        w, c = fit(x[np.setdiff1d(np.flatnonzero(train), inside)], y[np.setdiff1d(np.flatnonzero(train), inside), 0])
        earlier[inside, 0] = sigmoid(x[inside] @ w + c)
    both = np.hstack([x, earlier])
    w, c = fit(both[train], y[train, 1])
    plain = sigmoid(both @ w + c) >= 0.5
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(g < 1), t) for i, _, g, t in rows[:450]], "doc_id long, poor int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify_toxicity(d, lab, ["poor", "toxic"]).collect()}
    held = np.flatnonzero(~train)
    assert np.mean([got[i] == plain[i] for i in held]) > 0.93
    assert np.mean([got[i] == bool(y[i, 1]) for i in held]) >= np.mean(plain[held] == y[held, 1].astype(bool)) - 0.02


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated, very long rows and columns with the names that operators add."""
    rng = random.Random(13)
    long = words(rng, 120_000)
    rows = [(1, "fine words here", "a"), (1, "fine words here", "a"), (None, "fine words here", None), (2, None, "b"), (3, "", "b"), (4, long, "a"), (5, long, "c"), (6, "dull " * 200, "a")]
    taken = ["toxic", "p_poor", "p_toxic", "expected_grade", "tail_probability", "kept", "removed_lines", "size", "target", "fp", "component_id", "node", "code", "piece", "start", "length", "sequence_id", "offset", "ids_crc32"]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in taken})


def test_classifiers_of_odd_rows(spark, odd):
    lab = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (6, 1, 1), (4, 0, None), (None, 1, 1)], "doc_id long, poor int, toxic int")
    out = toxicity.classify_toxicity(odd, lab, ["poor", "toxic"])
    rows = out.collect()
    assert len(rows) == 8 and len(out.columns) == len(odd.columns) and all(isinstance(r["toxic"], bool) for r in rows)
    same = {(r["p_poor"], r["p_toxic"]) for r in rows if r["text"] == "fine words here"}
    assert len(same) == 1 and len({r["p_toxic"] for r in rows if not r["text"]}) == 1
    # a document whose probability is the threshold itself is toxic; above it is not
    p = next(iter(same))[1]
    for threshold, want in ((p, True), (np.nextafter(p, 1), False)):
        assert {r["toxic"] for r in toxicity.classify_toxicity(odd, lab, ["poor", "toxic"], threshold=float(threshold)).collect() if r["text"] == "fine words here"} == {want}
    ratings = spark.createDataFrame([(1, 2), (6, 0), (4, 1)], "doc_id long, grade int")
    graded = quality.grade_documents(odd, ratings, 1).collect()
    assert len(graded) == 8 and all(0 <= r["tail_probability"] <= 1 for r in graded)
    t = next(r["tail_probability"] for r in graded if r["doc_id"] == 1)
    assert all(r["kept"] for r in quality.grade_documents(odd, ratings, 1, keep_probability=t).collect() if r["doc_id"] == 1)


def test_text_operators_of_odd_rows(spark, odd):
    out = line_dedup.dedup_lines(odd).collect()
    assert len(out) == 8 and {r["text"] for r in out if r["doc_id"] in (2, 3)} == {None, ""}
    assert [len(r["text"]) > 0 for r in out if r["doc_id"] == 4] == [True] and next(r["text"] for r in out if r["doc_id"] == 5) == ""
    got = simhash.simhash_components(odd)
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == 8
    comp = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert comp[5] == 4 and comp[None] == 1 and comp[3] == comp[2] == 2
    packed = packing.pack_documents(odd, tokenizer_file()).collect()
    assert len({r["sequence_id"] for r in packed}) < len(packed) and sum(r["piece"] == 0 for r in packed) == 8
    assert {r["length"] for r in packed if r["doc_id"] == 4 and r["piece"]} == {1024}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_vectors_with_clashing_names_and_ties(spark, spread):
    x = clusters(np.random.default_rng(14), 300, 16, 6, spread)
    x[10] = x[20] = x[100]
    d = spark.createDataFrame([(i, [float(v) for v in r], 1, "own") for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int, query_id string")
    d = d.withColumns({c: F.lit("own") for c in ("id", "vec", "rank", "score", "cell", "home", "codes", "component_id", "n_links", "kept")})
    near = [r for r in mih.nearest_neighbours(d, F.col("vec_id") == 100).orderBy("rank").collect()]
    assert [(r["vec_id"], r["score"]) for r in near[:2]] == [(10, 0.0), (20, 0.0)] and len(near) == 10
    got = pq_dedup.near_duplicate_vectors(d)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and {r["component_id"] for r in got.where("vec_id in (10, 20, 100)").collect()} <= {r["vec_id"] for r in got.collect()}


def stages_of(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_of_nothing(spark, tmp_path):
    assert stages_of(spark, tmp_path, [], []).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(15)
    text = ". ".join(words(rng, 12) for _ in range(20))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text, None, None, None), (2, None, "en", "b", None), (3, "", "en", "b", 0), (None, None, None, None, None), (4, words(rng, 90_000), "de", "a", 1)]
    out = stages_of(spark, tmp_path, rows, [(1, 1, 0), (9, 0, 1), (None, 1, 1), (2, None, None)])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and {r["doc_id"] for r in out.collect()} <= {1, 2, 3, 4, None}
