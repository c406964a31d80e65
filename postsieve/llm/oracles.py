"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id > h.first AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id
), l AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, unnest(lines) AS line FROM d)
), judged AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, len(lw) > 0 AND (
      length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > len(lw) * 0.2
      OR len(list_filter(lw, lambda x: x LIKE '%!!')) > len(lw) * 0.3
      OR (len(regexp_extract_all(regexp_replace(line, '([ \t])', '\1\1', 'g'), '[ \t][|>»›·][ \t]')) >= 2
          AND NOT regexp_matches(line, '[.!?][\x20\x09-\x0D]*$'))
      OR (len(lw) <= 30 AND regexp_matches(lower(line), 'all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|(uses?|accept) cookies|enable javascript|lorem ipsum|click here|read more|sign up for|subscribe to our|skip to (main )?content|share (this )?on (facebook|twitter)|powered by '))
      OR (len(lw) >= 8 AND len(lw) - len(list_distinct(lw)) > len(lw) * 0.5)
    ) AS bad
  FROM l
), summed AS (
  SELECT doc_id, count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0) AS n_dup_lines,
         coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost
  FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, s.n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, s.lost
  FROM d JOIN summed s USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= word_chars * 0.5 AS kept
FROM base
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""

NEAR_VECTORS = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), u AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT u.vec_id, (SELECT count(*) FROM links l WHERE l.a = u.vec_id) AS n_links,
       least(u.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = u.vec_id), u.vec_id)) AS component_id,
       u.vec_id <= coalesce((SELECT min(b) FROM reach r WHERE r.a = u.vec_id), u.vec_id) AS kept
FROM u
"""


def vector_codes(rounds: int = 6) -> str:
    """Codebooks and codes by comparing every part with every entry, one pair of steps for each round."""
    steps = [r"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM (SELECT rid, v, unnest(range(8)) AS p FROM kept)
), b0 AS MATERIALIZED (
  SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= 16
)"""]
    given = r"""a{k} AS MATERIALIZED (
  SELECT rid, p, arg_min(e, d * 16 + e) AS e, min(d) AS d
  FROM (SELECT x.rid, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM parts x JOIN b{k} b ON x.p = b.p)
  GROUP BY rid, p
)"""
    moved = r"""b{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v
  FROM b{k} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS v
    FROM (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
          FROM (SELECT a.p, a.e, unnest(y.v) AS x, generate_subscripts(y.v, 1) AS i FROM a{k} a JOIN parts y ON a.rid = y.rid AND a.p = y.p)
          GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e
)"""
    for k in range(rounds):
        steps += [given.format(k=k), moved.format(k=k, n=k + 1)]
    steps.append(given.format(k=rounds))
    return "WITH " + ", ".join(steps) + rf""", coded AS (
  SELECT k.rid, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} a JOIN kept k ON a.rid = k.rid GROUP BY k.rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""
