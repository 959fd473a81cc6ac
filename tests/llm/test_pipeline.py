"""The registered queries against SQL on the smallest tables, and the pipeline's stages against plain versions."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_near_texts import plain_components
from test_text_operators import plain_dedup, plain_targets

import __spark_entry__
import corpus_pipeline
from loomwork.llm.queries import ORACLE, QUERIES, tokenizer_file

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_all_thirteen_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    out = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(str, out.select(names).collect())) == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, r, strict=True)) + ")" for r in cur.fetchall())


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, DATA), "test-stage")
        out.append((before, docs))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.orderBy("doc_id").collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_keeps_good_documents(spark, stages):
    kept = by_id(stages[0][1])
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean([i in kept for i in good]) > 0.98
    assert np.mean([r["doc_id"] in kept for r in labels if r["quality"] == 0]) < 0.5


def test_lines_equal_plain(stages):
    before, after = by_id(stages[1][0]), by_id(stages[1][1])
    ids = sorted(before)
    assert [after[i]["text"] for i in ids] == plain_dedup([before[i]["text"] for i in ids])
    assert all(after[i]["n_chars"] == len(after[i]["text"]) for i in ids)


def test_near_duplicates_equal_plain(stages):
    before, after = by_id(stages[2][0]), by_id(stages[2][1])
    ids = sorted(before)
    least = plain_components([before[i]["text"] for i in ids])
    assert sorted(after) == sorted({ids[k] for k in least})
    assert all(after[i] == before[i] for i in after)


def test_mix_meets_targets(stages):
    rows = stages[3][0].collect()
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
    for r in stages[3][1].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    for s, t in plain_targets(sizes).items():
        assert t - max(size.values()) <= taken.get(s, 0) <= t + 1e-6


def test_packing_holds_every_token(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    want = sorted(zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()[:4]) for r in stages[4][0].collect())
    rows = stages[4][1].collect()
    assert len(want) == sum(r["piece"] == 0 for r in rows)
    total = sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in stages[4][0].collect())
    assert total == sum(r["length"] for r in rows)
