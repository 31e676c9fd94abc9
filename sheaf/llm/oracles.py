"""DuckDB SQL of the operators that SQL can express, over whole tables and texts."""

REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
windows AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM twice),
grouped AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM grouped GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a, coalesce(b, n)) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

LEAKS = r"""
WITH words AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT d.doc_id, d.w, l.n, unnest(generate_series(1, len(d.w) - l.n + 1)) AS p FROM words d, lengths l WHERE len(d.w) >= l.n),
keyed AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM places),
found AS (SELECT keyed.doc_id, keyed.n, keyed.p, windows.item_id FROM keyed JOIN windows ON keyed.n = windows.n AND keyed.k = windows.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS t, unnest(generate_series(1, len(w))) AS p FROM words),
often AS (SELECT t, count(*) AS n FROM pos GROUP BY t),
terms AS (SELECT DISTINCT item_id, array_to_string(l, ' ') AS k, unnest(l) AS t, unnest(generate_series(1, len(l))) AS o FROM (SELECT item_id, w[p:p + n - 1] AS l FROM starts)),
rare AS (SELECT item_id, k, first(terms.t ORDER BY coalesce(n, 0), o) AS t, count(DISTINCT terms.t) AS m FROM terms LEFT JOIN often ON terms.t = often.t GROUP BY item_id, k),
homes AS (SELECT item_id, k, m, doc_id, p FROM rare JOIN pos ON pos.t = rare.t),
round AS (SELECT homes.item_id, homes.doc_id, homes.k, homes.p, m, count(DISTINCT terms.t) AS c FROM homes JOIN terms ON terms.item_id = homes.item_id AND terms.k = homes.k
  JOIN pos ON pos.doc_id = homes.doc_id AND pos.t = terms.t AND pos.p BETWEEN homes.p - 20 AND homes.p + 20 GROUP BY ALL),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM round WHERE c = m GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id LEFT JOIN named ON words.doc_id = named.doc_id LEFT JOIN near ON words.doc_id = near.doc_id"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 85 * (sx.n + sy.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, words.doc_id) AS component_id, coalesce(c, words.doc_id) = words.doc_id AS kept
FROM words LEFT JOIN sizes ON sizes.doc_id = words.doc_id LEFT JOIN least_of ON x = words.doc_id"""
