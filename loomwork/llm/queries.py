"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import materialise, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The url rules of the query: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.quality import grade_documents, ratings_of

    out = grade_documents(table(spark, sf_dir, "documents"), ratings_of(table(spark, sf_dir, "labels")), keep_grade=1)
    return out.select("doc_id", "expected_grade", "tail_probability", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.toxicity import categories_of, classify_toxicity

    out = classify_toxicity(table(spark, sf_dir, "documents"), categories_of(table(spark, sf_dir, "labels")), ["poor", "toxic"])
    return out.select("doc_id", "p_poor", "p_toxic", "toxic")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.url_cascade import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.simhash import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.warc import read_records, write_bundles

    rows = read_records(write_bundles(table(spark, sf_dir, "pages")), with_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.mih import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.pq_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.prefix_trie import conversation_trie, turn_sequences, with_shared_openings

    own = materialise(turn_sequences(table(spark, sf_dir, "conversations")), "trie-own-turns")
    return conversation_trie(with_shared_openings(own))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.decision_list import keep_by_rules

    out = keep_by_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    vec = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(256 * x.cast("double")).cast("double")))
    return hard_negatives(rows.select("vec_id", label.alias("label"), vec.alias("embedding")), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_url_filter, op3_toxicity, op4_line_dedup, op5_mix_sources, op6_simhash, op7_pack, op8_warc, op9_mih, op10_pq_dedup, op11_prefix_trie, op12_quality_rules, op13_hard_negatives)
}

_LINES = """
d AS (SELECT doc_id, text, string_split(regexp_replace(text, '(\\n|[.!?] )', '\\1' || chr(57344), 'g'), chr(57344)) AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM d),
v AS (SELECT doc_id, pos, md5(trim(translate(line, chr(10) || chr(13) || chr(9), '   '))) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM u),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS c FROM v WHERE w > 0),
s AS (SELECT doc_id, pos, max(pos) OVER x AS last, sum(w) OVER x AS words, md5(string_agg(h, ',') OVER x) AS content
  FROM c WINDOW x AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL SELECT doc_id, min(pos) OVER y AS pos, pos AS last, sum(w) OVER y AS words, md5(string_agg(h, ',') OVER y) AS content
  FROM c WINDOW y AS (PARTITION BY doc_id ORDER BY c + w RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, first_value({'i': doc_id, 'p': last}) OVER (PARTITION BY content ORDER BY doc_id, pos) AS one,
  row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS k FROM s WHERE words >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM f WHERE k > 1 AND (doc_id != one.i OR pos > one.p))
"""

ORACLE: dict[str, str] = {
    "op2_url_filter": """
WITH a AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS r FROM pages),
b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM a),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, max({'n': length(h || p), 'r': h || p, 'v': v}) AS best FROM b JOIN rules
  ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM b LEFT JOIN m USING (page_id)
""",
    "op4_line_dedup": f"""
WITH {_LINES},
k AS (SELECT u.doc_id, string_agg(u.line, '' ORDER BY u.pos) FILTER (gone.pos IS NULL) AS text, count(gone.pos) AS n
  FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.pos = gone.pos GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS removed_lines, CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END AS kept_chars,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS kept_md5
FROM d LEFT JOIN k USING (doc_id)
""",
    "op5_mix_sources": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS c, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(c) OVER () - coalesce(sum(3.0 * c) OVER (ORDER BY 3.0 * c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0 * c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM s),
t AS (SELECT source, c, least(3.0 * c, (SELECT arg_min(level, 3.0 * c / w) FROM l WHERE level <= 3.0 * c / w) * w)::DOUBLE AS target FROM l),
p AS (SELECT *, CASE WHEN c > 0 THEN floor(target / c) ELSE 0 END AS passes FROM t),
r AS (SELECT doc_id, d.source, size, c, target, passes, target - passes * c AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, c AS source_size, target, (size * (passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op8_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS holder FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != holder THEN holder END AS refers_to FROM m
""",
    "op10_pq_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x != 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS o FROM embeddings UNION SELECT r.n, l.y FROM r JOIN l ON l.x = r.o),
c AS (SELECT n, min(o) AS c FROM r GROUP BY n), k AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON n = vec_id LEFT JOIN k ON x = vec_id
""",
    "op11_prefix_trie": """
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], repeat([0::BIGINT], 8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
t AS (SELECT conv_id, turn, concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'d': md5(x), 'w': w} ORDER BY turn NULLS FIRST, md5(x)) AS turns FROM t GROUP BY conv_id),
c AS (SELECT o.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: ascii(y)::BIGINT)), lambda r, y: xor(r >> 8, tab[(xor(r, y) & 255) + 1])), 4294967295) % 4 AS h FROM o, bits),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS s FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(s) AS total, d, s[d].w AS w, md5(array_to_string(list_transform(s[1:d], lambda y: y.d), ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(s[1:d - 1], lambda y: y.d), ',')) END AS up
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d), '') AS ends FROM p GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
under AS (SELECT a.k, sum((m.kids = 0)::INT)::BIGINT AS leaves, sum(CASE WHEN m.d > 0 THEN (m.n - 1) * m.w ELSE 0 END)::BIGINT AS saved FROM m JOIN p a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.k)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN under ON under.k = m.k LEFT JOIN n q ON q.k = m.up
""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
""",
}
