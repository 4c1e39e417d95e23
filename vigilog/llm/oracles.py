"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

LLM_ORACLES: dict[str, str] = {}

LLM_ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words),
posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM posts a JOIN posts b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

LLM_ORACLES["op3_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, s.m, array_to_string(w[i:i + s.m - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) p
  JOIN (SELECT DISTINCT m FROM windows) s ON i + s.m - 1 <= len(w)),
hits AS (SELECT p.doc_id, p.i, p.m, w.item_id FROM places p JOIN windows w ON p.m = w.m AND p.g = w.g),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

# CRC-32 byte by byte over a table of 256 entries that SQL makes from the polynomial.
LLM_ORACLES["op5_sharding"] = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(n AS BIGINT))) AS t),
sized AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
digest AS (
  SELECT doc_id, source, size, draw, xor(4294967295, list_reduce(
    list_transform(range(1, size), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM sized, crc_table),
shares AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, size, text_crc32) - 0.5)::DOUBLE
    / count(*) OVER (PARTITION BY source) AS share
  FROM digest),
places AS (
  SELECT *, row_number() OVER (ORDER BY share, draw, source, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n
  FROM shares)
SELECT doc_id, source, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * 16 // n AS INTEGER) AS shard,
  CAST(pos - ((pos * 16 // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM places
"""

LLM_ORACLES["op10_suffix_dedup"] = r"""
WITH bodies AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS a, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM bodies WHERE n >= 50)),
firsts AS (SELECT s, min(doc_id) AS f FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
removed AS (SELECT t.doc_id, t.i FROM strings t JOIN firsts f ON t.s = f.s WHERE t.doc_id > f.f),
marked AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS gap FROM removed),
grouped AS (SELECT doc_id, i, sum(CASE WHEN gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, g, min(i) AS s, max(i) + 50 AS e FROM grouped GROUP BY doc_id, g),
kept AS (
  SELECT b.doc_id, string_agg(substr(b.h, 2 * k.s + 1, 2 * (k.e - k.s)), '' ORDER BY k.s) AS h
  FROM bodies b JOIN (
    SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM spans
    UNION ALL SELECT doc_id, max(e), 1000000000 FROM spans GROUP BY doc_id) k USING (doc_id)
  GROUP BY b.doc_id),
counts AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, b.h))) AS kept_sha256
FROM bodies b LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""

# Words are numbered within a document. Equal stretches of five words at a distance
# q join to the stretches of period q; those inside one of a smaller period go.
LLM_ORACLES["op11_periodic_runs"] = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(n AS BIGINT))) AS t),
split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM documents, crc_table),
drawn AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
docs AS (
  SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
    w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS w
  FROM drawn),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM docs),
grams AS (
  SELECT doc_id, n, i, hash(word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS g
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i
  FROM (SELECT * FROM grams WHERE i + 5 <= n) x JOIN (SELECT * FROM grams WHERE i + 5 <= n) y
    ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
wide AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 5 + q AS e FROM islands GROUP BY doc_id, q, k
  HAVING max(i) + 5 + q - min(i) >= greatest(6, 4 * q)),
runs AS (
  SELECT doc_id, s, e - s AS l, q FROM wide x WHERE NOT EXISTS (
    SELECT 1 FROM wide y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)),
digests AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS d,
    arg_max(s, (l, -s, -q)) AS s, max(l) AS l, arg_max(q, (l, -s, -q)) AS q
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT o.doc_id, CAST(len(o.w) AS BIGINT) AS n_words, CAST(coalesce(d.n_runs, 0) AS BIGINT) AS n_runs,
  CAST(d.s AS BIGINT) AS start, CAST(d.l AS BIGINT) AS length, CAST(d.q AS BIGINT) AS period,
  CAST(1000 * d.l // d.q AS BIGINT) AS exponent_milli, coalesce(d.d, sha256('')) AS runs_sha256,
  sha256(coalesce(x.body, '')) AS collapsed_sha256
FROM docs o LEFT JOIN digests d USING (doc_id) LEFT JOIN left_over x USING (doc_id)
"""

LLM_ORACLES["op13_hard_negatives"] = r"""
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
