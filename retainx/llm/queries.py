"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retainx.llm.anchor_tree import negatives_query
from retainx.llm.collocations import collocations_query
from retainx.llm.impact_index import topk_query
from retainx.llm.language_id import language_query
from retainx.llm.line_dedup import lines_query
from retainx.llm.mixing import mixing_query
from retainx.llm.ngram_join import join_query
from retainx.llm.order_minhash import fingerprints_query
from retainx.llm.packing import packing_query
from retainx.llm.prefix_forest import neighbours_query
from retainx.llm.quality import quality_query
from retainx.llm.secret_scan import secrets_query
from retainx.llm.url_filter import urls_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets_query,
    "op2_prefix_forest": neighbours_query,
    "op3_language_id": language_query,
    "op4_ngram_join": join_query,
    "op5_url_filter": urls_query,
    "op6_order_minhash": fingerprints_query,
    "op7_mixing": mixing_query,
    "op8_packing": packing_query,
    "op9_line_dedup": lines_query,
    "op10_quality": quality_query,
    "op11_collocations": collocations_query,
    "op12_hard_negatives": negatives_query,
    "op13_topk_search": topk_query,
}

ORACLES: dict[str, str] = {
    "op4_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
p AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, len(s.sh)
""",
    "op11_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \\t]+') IF x <> ''] AS ws FROM pieces),
grams AS (
  SELECT lang, m, unnest([ws[i:i + m - 1] FOR i IN range(1, len(ws) - m + 2)]) AS g
  FROM w, (VALUES (1), (2), (3), (4)) o(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE m >= 2 AND f >= 30),
inside AS (
  SELECT lang, m, f AS longer, unnest([[m - s, s, i] FOR i IN range(1, s + 2)]) AS cut, g FROM cand, (VALUES (1), (2)) d(s) WHERE m - s >= 2),
dominated AS (
  SELECT DISTINCT c.lang, c.g FROM cand c JOIN inside i ON c.lang = i.lang AND c.g = i.g[i.cut[3]:i.cut[3] + i.cut[1] - 1]
  WHERE 100 * i.longer::HUGEINT >= 80 * c.f::HUGEINT),
cuts AS (SELECT lang, g, f, unnest(range(1, m)) AS k, m FROM cand c WHERE NOT EXISTS (SELECT 1 FROM dominated d WHERE d.lang = c.lang AND d.g = c.g)),
scored AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT) // (x.f + y.f)::HUGEINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:c.m]),
low AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT r.lang, r.rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END) AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.id <> c.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
""",
    "op13_topk_search": """
WITH v AS (
  SELECT DISTINCT vec_id AS id, [floor(256 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""",
}
