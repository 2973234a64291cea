"""DuckDB SQL with the same rows as the queries."""

from __future__ import annotations

from . import centroids
from .line_rules import MAX_DOCS, MAX_REMOVED, MAX_SHARE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), sized AS (
  SELECT *, 32 + length(esc(role)) + length(esc(text)) AS chars FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM summed GROUP BY conv_id
"""
for column in ("role", "text"):
    CHAT = CHAT.replace(f"esc({column})", "regexp_replace(regexp_replace(%s, '(\\\\|<(/?s>)|\\[(/?INST\\]))', 'x\\0', 'g'), '<\\|', 'x<|', 'g')" % column)

RULES = rf"""
WITH base AS (
  SELECT doc_id, coalesce('h:' || source, '') AS host, coalesce(text, '') AS text, {WORDS} AS w,
    row_number() OVER () AS r FROM documents
), lines AS (
  SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM base
), worded AS (
  SELECT r, host, text, line,
    trim(regexp_replace({LOWER.format('line')}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY r
), frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM worded GROUP BY ALL)
  JOIN (SELECT host, count(DISTINCT text) AS total FROM base GROUP BY host) USING (host)
  WHERE n > {MAX_DOCS} AND n > {MAX_SHARE} * total
), lost AS (
  SELECT r, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS removed_words
  FROM worded JOIN frequent USING (host, norm) GROUP BY r
), grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), counted AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM base LEFT JOIN dup USING (r) LEFT JOIN lost USING (r) LEFT JOIN repeated USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= {MAX_REMOVED} * n_words AS kept
FROM counted
"""

CLEAN = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {CLEAN} AS w FROM benchmark),
windows AS (
  SELECT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {CLEAN} AS w, row_number() OVER () AS r FROM documents),
hits AS (
  SELECT r, i, p.k, item FROM (
    SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
      SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
  ) p JOIN windows USING (k, g)
), covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

JOIN = rf"""
WITH RECURSIVE classes AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS class_id, count(*) AS class_size, row_number() OVER () AS c FROM documents GROUP BY ALL
), cut AS (
  SELECT c, regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM classes
), grams AS (
  SELECT DISTINCT c, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT c, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM cut WHERE len(w) > 0)
), sizes AS (SELECT c, count(*) AS n FROM grams GROUP BY c),
links AS (
  SELECT a.c AS a, b.c AS b FROM (SELECT x.c AS a, y.c AS b, count(*) AS n FROM grams x JOIN grams y USING (g) WHERE x.c <> y.c GROUP BY ALL) p
  JOIN sizes a ON a.c = p.a JOIN sizes b ON b.c = p.b WHERE p.n >= 0.8 * (a.n + b.n - p.n)
), reach AS (
  SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), groups_ AS (SELECT a AS c, min(class_id) AS group_id FROM reach JOIN classes ON classes.c = b GROUP BY a),
counts AS (SELECT a AS c, count(*) AS n_links, sum(class_size) AS n_linked_rows FROM links JOIN classes ON classes.c = b GROUP BY a)
SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links, CAST(coalesce(n_linked_rows, 0) AS BIGINT) AS n_linked_rows, group_id
FROM documents d JOIN classes ON classes.text = coalesce(d.text, '') JOIN groups_ USING (c) LEFT JOIN counts USING (c)
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS n FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, n = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

#: Scores of all anchors with all rows, then the windows one by one.
NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b, s.score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INT) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 3
"""


def centroid_sql(k: int, rounds: int, scale: int, dim: int, seed: int) -> str:
    """Lloyd's rounds as one chain of steps, a row per component."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {k}
), m0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM c0)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, c, dist FROM (SELECT r, c, sum((x.x - m.x) * (x.x - m.x)) AS dist FROM x JOIN m{i} m USING (d) GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)""")
        if i < rounds:
            parts.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT m.c, m.d, coalesce(n.x, m.x) AS x FROM m{i} m
  LEFT JOIN (SELECT c, d, CAST(floor((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*)) AS BIGINT) AS x FROM a{i} JOIN x USING (r) GROUP BY c, d) n USING (c, d))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM m{rounds} GROUP BY c) USING (c)
"""


SQL = {"op3_chat": CHAT, "op7_quality_rules": RULES, "op8_decontamination": LEAKS, "op10_ngram_join": JOIN,
    "op11_centroids": centroid_sql(centroids.K, centroids.ROUNDS, centroids.SCALE, centroids.DIM, centroids.SEED),
    "op12_hard_negatives": NEGATIVES, "op13_exact_dedup": EXACT}
