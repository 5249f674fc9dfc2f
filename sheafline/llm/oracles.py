"""DuckDB SQL for operators whose own modules hold no SQL."""

from __future__ import annotations

SUBSTRING_WORDS = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM late),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM tokens ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Texts as hexadecimal digits, two a byte, as the engine cuts no binary strings.
SUBSTRING_BYTES = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM docs WHERE length(h) >= 400)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
runs AS (SELECT r, p, sum(CASE WHEN p <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, lag(p, 1, -1000) OVER (PARTITION BY r ORDER BY p) AS before FROM twice)),
spans AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM runs GROUP BY r, run),
gaps AS (SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS a, s AS z, s, e FROM spans),
kept AS (SELECT r, count(*)::BIGINT AS n_spans, sum(e - s)::BIGINT AS n_removed, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS left_ FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE shared.n >= 0.8 * (a.n + b.n - shared.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id)::BIGINT AS class_size, doc_id = class_id AS kept FROM classes
"""

CONTAMINATION = r"""
WITH tokens AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
phrases AS (
  SELECT id AS item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM tokens WHERE kind = 'i' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM phrases),
places AS (
  SELECT id AS doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM tokens, sizes WHERE kind = 'd' AND len(w) >= n)),
found AS (SELECT doc_id, item_id, p, n FROM places JOIN phrases USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT i)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM tokens LEFT JOIN hits ON hits.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE kind = 'd'
"""
