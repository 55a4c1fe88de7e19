"""Queries of this subpackage: one per operator, over its whole input table.

Each query only derives the contract's columns from its operator. ``ORACLE``
holds DuckDB SQL where SQL expresses the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threatsift.llm import bitslice, collocations, conversation_repair, jaccard, mixing, packing, pii, projections, quality, secret_scan, token_counts, toxicity, url_filters
from threatsift.llm.common import prepare, read_table

QUERY_EVERY = 50


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_bitsliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(read_table(spark, sf_dir, "embeddings"), QUERY_EVERY)


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return conversation_repair.audit_conversations(conversations, conversation_repair.damaged(conversations))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


_ALL = (op1_pii, op2_toxicity, op3_embedding_near_dedup, op4_best_fit_packing, op5_token_counts, op6_quality, op7_bitsliced_top_k,
        op8_parity_sketch_join, op9_url_filters, op10_source_mixing, op11_secret_scan,
        op12_conversation_repair, op13_collocations)


def _shipped(fn: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    return run


QUERIES: dict[str, Callable] = {f.__name__: _shipped(f) for f in _ALL}

# Reachability over links in plain SQL: every pair of one component.
_REACH = """reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""

_NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT s.vec_id AS a, t.vec_id AS b FROM v s JOIN v t ON s.vec_id <> t.vec_id AND len(s.x) = len(t.x)
  WHERE list_cosine_similarity(s.x, t.x) >= 0.95),
""" + _REACH + """,
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

_TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: floor(256 * e)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(generate_series(1, len(q.x)), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
           lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS s, len(g) AS n FROM g),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.s = y.s AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
""" + _REACH + """,
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(c.m, doc_id)) AS component_id
FROM g LEFT JOIN c ON c.a = g.doc_id
"""

_COLLOCATIONS = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f AS (
  SELECT lang, [a] AS w, count(*) AS f FROM t GROUP BY ALL
  UNION ALL SELECT lang, [a, b], count(*) FROM t WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [a, b, c], count(*) FROM t WHERE c IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
c AS (SELECT lang, w, f AS a FROM f WHERE len(w) > 1 AND f >= 10),
g AS MATERIALIZED (SELECT lang, array_to_string(w, ' ') AS p, f FROM f WHERE f >= 10),
h AS MATERIALIZED (SELECT lang, w, a, k, array_to_string(w[1:k], ' ') AS pl, array_to_string(w[k + 1:], ' ') AS pr
      FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)),
s AS (
  SELECT h.lang, h.w, h.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * h.a * h.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM h JOIN g x ON x.lang = h.lang AND x.p = h.pl JOIN g y ON y.lang = h.lang AND y.p = h.pr
  QUALIFY row_number() OVER (PARTITION BY h.lang, h.w ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([w[1:2], w[2:3]]) AS w, a FROM c WHERE len(w) = 3),
m AS (SELECT lang, w, max(a) AS m FROM inner_ GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.w, ' ') COLLATE "BINARY")::BIGINT AS rank,
       array_to_string(s.w, ' ') AS phrase, a, l, r, n, score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN m ON m.lang = s.lang AND m.w = s.w
WHERE m.m IS NULL OR 100 * m.m < 50 * a
QUALIFY rank <= 2000
"""

# The other operators are trained, random or depend on a tokenizer file.
ORACLE: dict[str, str] = {
    "op3_embedding_near_dedup": _NEAR_VECTORS,
    "op7_bitsliced_top_k": _TOP_K,
    "op8_parity_sketch_join": _JACCARD,
    "op9_url_filters": url_filters.ORACLE,
    "op11_secret_scan": secret_scan.ORACLE,
    "op13_collocations": _COLLOCATIONS,
}
