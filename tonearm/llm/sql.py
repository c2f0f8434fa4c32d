"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, p, md5(substr(h, (2 * p + 1)::BIGINT, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS p FROM d)),
r AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
spans AS (SELECT doc_id, g, min(p) AS a, max(p) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM r) GROUP BY ALL),
kept AS (SELECT doc_id, a, substr(h, (2 * behind + 1)::BIGINT, (2 * (a - behind))::BIGINT) AS piece FROM
  (SELECT x.doc_id, x.a, coalesce(lag(x.b) OVER (PARTITION BY x.doc_id ORDER BY x.a), 0) AS behind, d.h FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM d) x JOIN d USING (doc_id)))
SELECT doc_id, any_value(n) AS n_bytes, coalesce(any_value(removed), 0)::BIGINT AS n_removed, coalesce(any_value(runs), 0)::BIGINT AS n_spans, sha256(unhex(string_agg(piece, '' ORDER BY a))) AS kept_sha256
FROM kept JOIN d USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS runs FROM spans GROUP BY doc_id) USING (doc_id) GROUP BY doc_id
"""

DE_BRUIJN = f"""
WITH w AS (SELECT doc_id, {SPLIT.format(text="coalesce(text, '')")} AS words FROM documents),
win AS (SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS s FROM w)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM (SELECT win.doc_id, s, unnest(range(0, 13)) AS o FROM win JOIN first USING (k) WHERE m < win.doc_id)),
each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[s:s + 3], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
