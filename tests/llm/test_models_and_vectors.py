"""Classifiers by held-out accuracy, vectors against brute force, archives by round trip, components, and edge cases."""

import base64
import hashlib
import random

import numpy as np
import pytest

from loomwork.llm import components, hashed_text, mih, pq_dedup, quality, toxicity, warc


def texts_with_grades(rng, n):
    good, bad, vile = [[f"{p}{i}" for i in range(300)] for p in ("fine", "dull", "rude")]
    rows = []
    for i in range(n):
        g = rng.randrange(5)
        pool = [*rng.choices(good, k=10 * g), *rng.choices(bad, k=10 * (4 - g))]
        toxic = rng.random() < 0.3
        if toxic:
            pool += rng.choices(vile[:20], k=3)
        rng.shuffle(pool)
        rows.append((i, " ".join(pool), g, int(toxic)))
    return rows


def test_ordinal_grades_on_held_out_texts(spark):
    rows = texts_with_grades(random.Random(1), 900)
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    r = spark.createDataFrame([(i, g) for i, _, g, _ in rows[:600]], "doc_id long, grade int")
    out = {x["doc_id"]: x for x in quality.grade_documents(d, r, keep_grade=3).collect()}
    err = [abs(out[i]["expected_grade"] - g) for i, _, g, _ in rows[600:]]
    assert np.mean(err) < 0.5
    assert np.mean([out[i]["kept"] == (g >= 3) for i, _, g, _ in rows[600:]]) > 0.9
    assert all(0 <= out[i]["tail_probability"] <= 1 for i in out)


def test_thresholds_are_ordered():
    rows = texts_with_grades(random.Random(2), 300)
    slots, starts = hashed_text.text_slots([t for _, t, _, _ in rows])
    words = np.array([len(set(t.split())) for _, t, _, _ in rows], float)
    cut, _ = quality.fit_ordinal(slots, starts, words, np.array([g for _, _, g, _ in rows]), 5)
    assert (np.diff(cut) > 0).all()


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, "a", 5.0), (2, None, 6.0), (None, "", 7.0)], "doc_id long, text string, expected_grade double")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, grade int")
    assert [(r["expected_grade"], r["kept"]) for r in quality.grade_documents(d, none, 1).collect()] == [(None, True)] * 3
    one = spark.createDataFrame([(1, 2), (1, 2)], "doc_id long, grade int")
    assert {(r["expected_grade"], r["tail_probability"]) for r in quality.grade_documents(d, one, 1).collect()} == {(2.0, 1.0)}
    two = spark.createDataFrame([(1, 2), (2, 0), (9, 1)], "doc_id long, grade int")
    assert quality.grade_documents(d, two, 1).count() == 3
    assert quality.grade_documents(d.limit(0), two, 1).count() == 0


def test_toxicity_chain_on_held_out_texts(spark):
    rows = texts_with_grades(random.Random(3), 900)
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(g < 1), t) for i, _, g, t in rows[:600]], "doc_id long, poor int, toxic int")
    out = {x["doc_id"]: x for x in toxicity.classify_toxicity(d, lab, ["poor", "toxic"]).collect()}
    assert np.mean([out[i]["toxic"] == bool(t) for i, _, _, t in rows[600:]]) > 0.95


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    slots, starts = hashed_text.text_slots([f"{'yes' if a else 'no'} word{rng.integers(50)}" for a in y])
    links = toxicity.fit_chain(slots, starts, np.stack([y, y], 1).astype(float), np.arange(400) % 3)
    assert len(links[1]) == len(links[0]) + 1 and links[1][hashed_text.SLOTS] > 0


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, poor int, toxic int")
    assert {(r["p_toxic"], r["toxic"]) for r in toxicity.classify_toxicity(d, none, ["poor", "toxic"]).collect()} == {(None, False)}
    few = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, None, 0)], "doc_id long, poor int, toxic int")
    assert toxicity.classify_toxicity(d, few, ["poor", "toxic"]).count() == 3


# ---- vectors ----


def clusters(rng, n, d, centres, noise):
    c = rng.standard_normal((centres, d))
    return (c[rng.integers(centres, size=n)] + noise * rng.standard_normal((n, d))).astype(np.float32)


ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, None] + [0.0] * 14, [1.0] * 7]


def frame(spark, x, labels=None):
    rows = [(i, [float(a) for a in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    rows += [(len(x) + i, v, 0) for i, v in enumerate(ODD)] + [(None, [1.0] * x.shape[1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("noise", [0.1, 3.0])
def test_mih_recall_and_scores(spark, noise):
    from pyspark.sql import functions as F

    x = clusters(np.random.default_rng(5), 1500, 16, 40, noise)
    x[7] = x[100]
    got = mih.nearest_neighbours(frame(spark, x), F.col("vec_id") % 100 == 0).collect()
    by, hits = {}, 0
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 100))
    y = x.astype(np.float64)
    for q, rows in by.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(len(y)), d))[:10]
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert all(abs(d[r["vec_id"]] - r["score"]) < 1e-12 for r in rows)
        assert rows == sorted(rows, key=lambda r: (r["score"], r["vec_id"]))
        hits += len(set(true) & {r["vec_id"] for r in rows})
    assert hits >= 0.93 * 10 * len(by)


def test_mih_part_radii_cover_the_radius():
    for r in range(64):
        assert sum(a + 1 for a in mih.part_radii(r)) >= r + 1


def test_mih_edges(spark):
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [1.0, 2.5]), (100, [4.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in mih.nearest_neighbours(few, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 1)]
    assert mih.nearest_neighbours(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert mih.nearest_neighbours(few.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize(("cell", "noise", "centroids"), [(2048, 0.2, 1024), (64, 0.2, 1024), (64, 0.02, 1024), (16, 0.2, 5)])
def test_pq_links_equal_brute_force(spark, monkeypatch, cell, noise, centroids):
    monkeypatch.setattr(pq_dedup, "CELL", cell)
    monkeypatch.setattr(pq_dedup, "MOST_CENTROIDS", centroids)
    rng = np.random.default_rng(6)
    x, labels = clusters(rng, 600, 16, 60, noise), rng.integers(2, size=600)
    x[:120] = x[0] + 1e-4 * rng.standard_normal((120, 16)).astype(np.float32)
    x[5] = x[4] * 3
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    label = np.arange(600)
    for _ in range(600):
        new = np.minimum(label, np.where(link, label[None], 600).min(1))
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicate_vectors(frame(spark, x, labels)).collect()}
    assert len(got) == 600 + len(ODD) + 1
    assert [got[i]["n_links"] for i in range(600)] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(600)] == label.tolist()
    assert all(got[i]["kept"] == (label[i] == i) for i in range(600))
    assert all((got[600 + i]["n_links"], got[600 + i]["component_id"], got[600 + i]["kept"]) == (0, 600 + i, True) for i in range(len(ODD)))


def test_pq_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert pq_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (4, [0.0, 1.0], 1)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in pq_dedup.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 2, 1), ("3", 0, 3), ("4", 0, 4), ("None", 0, None)]


# ---- components ----


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (None, 4), (500, 501), (501, 500), (500, 501)]
    rng.shuffle(edges)
    got = {}
    for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(61)), list(range(100, 180)), [500, 501]]
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- archives ----


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    html = [f"<p>{'x' * (i % 50) * 20}{i % 37}é</p>" for i in range(300)] + [None, "", "", "WARC/1.1\r\n\r\n trap \r\n\r\n", "<b>" + "z" * 100_000]
    ids = list(range(len(html)))
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", h, "odd") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, kind string")
    index = warc.write_bundles(pages, f"{tmp_path}/w")
    got = {r["id"]: r for r in warc.read_bundles(spark, index, with_payload=True).collect()}
    holder = {}
    for i, h in zip(ids, html, strict=True):
        holder[h or ""] = max(i, holder.get(h or "", -1))
    for i, h in zip(ids, html, strict=True):
        body = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if holder[h or ""] == i else ("revisit", holder[h or ""]))
        assert r["payload"] == (body if r["record_type"] == "response" else None)
    some = warc.read_records(index.where("page_id in (5, 301, 304)")).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in some} == {i: (got[i]["payload_bytes"], got[i]["record_type"]) for i in (5, 301, 304)}
    import glob

    import zstandard

    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in glob.glob(f"{tmp_path}/w/*.zst"))
    assert plain.count(b"WARC-Record-ID: ") == len(html)
    assert index.selectExpr("max(frame)").first()[0] > 1


def test_warc_ids_of_any_characters(spark):
    ids = ["a\nb", "null", "", "é %41>", "x: y\r\n\r\n", None, "urn:page-without-id"]
    pages = spark.createDataFrame([(i, "u", "same" if k % 2 else str(k), "w") for k, i in enumerate(ids)], "page_id string, url string, html string, id string")
    index = warc.write_bundles(pages)
    want = {}
    largest = max(i for k, i in enumerate(ids) if k % 2 and i is not None)
    for k, i in enumerate(ids):
        want[i] = ("revisit", largest) if k % 2 and i != largest else ("response", None)
    for rows in (warc.read_records(index), warc.read_bundles(spark, index, "string").withColumnRenamed("id", "page_id")):
        assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows.collect()} == want


def test_warc_of_many_equal_rows(spark):
    pages = spark.createDataFrame([(7, "u", "a" * 100)] * 3000 + [(3, "u", "a" * 100)], "page_id long, url string, html string")
    out = warc.read_records(warc.write_bundles(pages), with_payload=False).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert sorted(map(tuple, out), key=str) == [(3, "revisit", 7, 1), (7, "response", None, 3000)]


def test_store_names():
    from pyarrow import fs

    assert warc.open_store("/tmp/x")[1] == "/tmp/x" and isinstance(warc.open_store("file:///tmp/x")[0], fs.LocalFileSystem)
    store, path = warc.open_store("s3a://bucket/x?region=us-east-1")  # named, so that nothing is looked up
    assert isinstance(store, fs.S3FileSystem) and path == "bucket/x"


def test_warc_edges(spark):
    schema = "page_id long, url string, html string"
    assert warc.write_bundles(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, "a"), (3, "u", "a"), (3, "u", "a"), (None, "v", "b")]
    index = warc.write_bundles(spark.createDataFrame(rows, schema))
    got = sorted((str(r["id"]), r["record_type"], r["refers_to"]) for r in warc.read_bundles(spark, index).collect())
    assert got == [("3", "response", None), ("3", "response", None), ("None", "response", None), ("None", "revisit", 3)]
    index = warc.write_bundles(spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b"), (4, "u", "b")], schema), min_bytes=2)
    got = sorted((r["id"], r["record_type"]) for r in warc.read_bundles(spark, index).collect())
    assert got == [(1, "revisit"), (2, "response"), (3, "response"), (4, "response")]
