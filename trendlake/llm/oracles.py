"""DuckDB SQL for the operators that SQL can express, worked out another way than theirs: all pairs, all windows, a table of states."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Cosines of all pairs under one label; the smallest id is handed on along links until none changes.
EMBEDDINGS = """
WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT *, sqrt(list_inner_product(x, x)) AS n FROM good),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(least(a, b)) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN degree USING (vec_id)"""

#: Windows of documents and items as texts, met by equality.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
win AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM item))),
met AS (SELECT doc_id, item_id, size, i FROM win JOIN item USING (size, win)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: Integer scores of all rows under each anchor.
NEGATIVES = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM q a JOIN q r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY rank <= 10"""

#: The best path to each state behind each row: a cost of six digits, then a letter and the written role for each edit. A path's roles follow from
#: its letters, so the least text is the least cost with the least letters.
REPAIR = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM hashed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM damaged),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nth) AS before FROM placed),
faulty AS (SELECT conv_id, turn, role, text, nth, initial, before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM told),
step(a, x, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
put AS (SELECT a, b, 5 AS price, 'I' || x AS letters FROM step WHERE x <> 's'),
puts AS (SELECT unnest(range(4)) AS a, a AS b, 0 AS price, '' AS letters UNION ALL FROM put UNION ALL SELECT p.a, q.b, 10, p.letters || q.letters FROM put p JOIN put q ON p.b = q.a),
edit AS (SELECT p.a, s.b, s.x AS initial, false AS dropped, p.price, p.letters || 'K' || s.x AS letters FROM puts p JOIN step s ON p.b = s.a
  UNION ALL SELECT p.a, s.b, NULL, false, p.price + 1, p.letters || 'R' || s.x FROM puts p JOIN step s ON p.b = s.a WHERE s.x <> 's'
  UNION ALL SELECT a, b, NULL, true, price + 2, letters || 'D-' FROM puts),
best AS (SELECT DISTINCT conv_id, 0::BIGINT AS nth, 0::BIGINT AS state, '000000' AS path FROM faulty
  UNION ALL SELECT f.conv_id, f.nth, e.b::BIGINT, min(lpad((left(path, 6)::INT + price + CASE WHEN fault = 'truncated' AND NOT dropped THEN 5 ELSE 0 END)::VARCHAR, 6, '0') || substr(path, 7) || letters)
  FROM best JOIN faulty f ON f.conv_id = best.conv_id AND f.nth = best.nth + 1 JOIN edit e ON e.a = state AND (e.initial IS NULL OR e.initial = f.initial) AND (dropped OR fault NOT IN ('blank', 'duplicate')) GROUP BY ALL),
ended AS (SELECT conv_id, min(lpad((left(path, 6)::INT + price)::VARCHAR, 6, '0') || substr(path, 7) || letters) AS path FROM best JOIN puts p ON p.a = state AND p.b IN (0, 3)
  JOIN (SELECT conv_id, max(nth) AS last FROM faulty GROUP BY conv_id) USING (conv_id) WHERE nth = last GROUP BY conv_id),
letter AS (SELECT conv_id, pos, path[5 + 2 * pos] AS kind, path[6 + 2 * pos] AS x FROM (SELECT conv_id, path, unnest(range(1, (len(path) - 6) // 2 + 1)) AS pos FROM ended)),
read AS (SELECT *, count(*) FILTER (kind <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM letter),
line AS (SELECT r.conv_id, pos, CASE WHEN kind = 'K' THEN role WHEN x = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN kind = 'I' THEN '' ELSE text END AS said FROM read r LEFT JOIN faulty f ON f.conv_id = r.conv_id AND f.nth = r.nth WHERE kind <> 'D'),
whole AS (SELECT conv_id, string_agg(said, chr(10) ORDER BY pos) AS said FROM line GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(path, 6)::BIGINT, 0) AS cost,
  coalesce(regexp_replace(substr(path, 7), '(.).', '\1', 'g'), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id) LEFT JOIN whole USING (conv_id)"""
